"""Exchange formats for atoms: JSON, NDJSON, YAML and CSV; checks on the way in, a filter on the way out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "struct<subject:bigint,predicate:bigint,object_tag:int,object_value:bigint,qualifiers:int>"
EVIDENCE = "struct<atom_id:string,section_kind:string,offset:bigint,length:bigint,trust:int>"
ATOM = f"id string, atom_type string, claims array<{CLAIM}>, evidence array<{EVIDENCE}>, metadata struct<created_at:bigint,trust_level:int,domain_mask:bigint,source_id:int>, payload string"
CSV = "id string, atom_type string, subject string, predicate string, object_tag string, object_value string, qualifiers string, created_at string, trust_level string, domain_mask string, source_id string, payload string, evidence_json string, ev_atom_id string, ev_section_kind string, ev_offset string, ev_length string, ev_trust string"
SECTIONS = ("SYMBOLS", "CLAIMS", "EVIDENCE", "META", "EDGES", "INVARIANTS", "REFS")
ATOM_TYPES = ("DEFINITION", "FACT", "HYPOTHESIS", "OBSERVATION", "PROCEDURE", "AXIOM", "THEOREM", "EXAMPLE", "COUNTEREXAMPLE", "QUESTION", "ANSWER", "SOURCE", "MAP")


def read_atoms(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Atoms from a file or folder. ``json``: an array or an object; ``ndjson``: one a line; ``yaml``: documents; ``csv``: one claim a row."""
    match fmt:
        case "json":
            return spark.read.schema(ATOM).option("multiLine", True).json(path)
        case "ndjson" | "json-lines":
            return spark.read.schema(ATOM).json(path)
        case "yaml":
            return _read_yaml(spark, path)
        case "csv":
            return atoms_from_csv(spark.read.schema(CSV).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, quote='"', escape='"', multiLine=True))
    raise ValueError(f"unknown format {fmt}")


def _read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML has no reader in Spark: whole files are parsed in the tasks, by PyYAML where it is installed, else as the JSON subset."""

    def parse(text: str) -> list[str]:
        try:
            import yaml
        except ImportError:
            docs = [json.loads(text)]
        else:
            docs = list(yaml.safe_load_all(text))
        return [json.dumps(a) for d in docs if d is not None for a in (d if isinstance(d, list) else [d])]

    lines = spark.read.text(path, wholetext=True).select(F.explode(F.udf(parse, "array<string>")("value")).alias("j"))
    return lines.select(F.from_json("j", ATOM).alias("a")).select("a.*")


def atoms_from_csv(rows: DataFrame) -> DataFrame:
    """Rows that share an id are one atom, in order of appearance; a row without one is an atom by itself."""
    n = F.monotonically_increasing_id()
    r = rows.withColumn("__row", n).withColumn("__key", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("__row_"), F.col("__row").cast("string"))))
    num = lambda c, t: F.expr(f"try_cast(trim({c}) as {t})")
    claim = F.when(F.nullif(F.trim("subject"), F.lit("")).isNotNull(), F.struct("__row", F.struct(num("subject", "bigint").alias("subject"), num("predicate", "bigint").alias("predicate"), num("object_tag", "int").alias("object_tag"), num("object_value", "bigint").alias("object_value"), num("qualifiers", "int").alias("qualifiers")).alias("v")))
    flat = F.when(F.nullif(F.trim("ev_atom_id"), F.lit("")).isNotNull(), F.array(F.struct(F.trim("ev_atom_id").alias("atom_id"), F.trim("ev_section_kind").alias("section_kind"), num("ev_offset", "bigint").alias("offset"), num("ev_length", "bigint").alias("length"), num("ev_trust", "int").alias("trust")))).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    listed = F.coalesce(F.from_json("evidence_json", f"array<{EVIDENCE}>"), F.array().cast(f"array<{EVIDENCE}>"))
    meta = F.struct(num("created_at", "bigint").alias("created_at"), num("trust_level", "int").alias("trust_level"), num("domain_mask", "bigint").alias("domain_mask"), num("source_id", "int").alias("source_id"))
    first = lambda c: F.min_by(c, "__row")
    g = r.withColumns({"__claim": claim, "__ev": F.concat(listed, flat), "__meta": meta}).groupBy("__key").agg(
        F.min("__row").alias("__first"), first("id").alias("id"), first("atom_type").alias("atom_type"),
        F.transform(F.array_sort(F.collect_list("__claim")), lambda x: x["v"]).alias("claims"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__row", "__ev"))), lambda x: x["__ev"]))).alias("evidence"),
        first("__meta").alias("metadata"), first("payload").alias("payload"))
    return g.select(F.nullif(F.trim("id"), F.lit("")).alias("id"), "atom_type", "claims", "evidence", "metadata", "payload")


def csv_rows(atoms: DataFrame) -> DataFrame:
    """One row a claim; an atom without claims has a row, too."""
    a = atoms.select("*", F.explode_outer("claims").alias("c"))
    s = lambda c: F.col(c).cast("string")
    return a.select("id", "atom_type", s("c.subject").alias("subject"), s("c.predicate").alias("predicate"), s("c.object_tag").alias("object_tag"), s("c.object_value").alias("object_value"), s("c.qualifiers").alias("qualifiers"), s("metadata.created_at").alias("created_at"), s("metadata.trust_level").alias("trust_level"), s("metadata.domain_mask").alias("domain_mask"), s("metadata.source_id").alias("source_id"), "payload", F.to_json("evidence").alias("evidence_json"), *[F.lit(None).cast("string").alias(x) for x in ("ev_atom_id", "ev_section_kind", "ev_offset", "ev_length", "ev_trust")])


def write_atoms(atoms: DataFrame, path: str, fmt: str) -> None:
    match fmt:
        case "json" | "ndjson" | "json-lines" | "yaml":  # a line of JSON is YAML, too
            atoms.write.mode("overwrite").json(path)
        case "csv":
            csv_rows(atoms).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
        case _:
            raise ValueError(f"unknown format {fmt}")


def problems() -> Column:
    """What is wrong with an atom to import; an empty list if nothing."""
    hex_ = r"^\p{XDigit}{64}$"
    return F.array_compact(F.array(
        F.when(F.col("id").isNotNull() & ~F.col("id").rlike(hex_), "id"),
        F.when(F.upper("atom_type").isin(*ATOM_TYPES), None).otherwise("atom_type"),
        F.when(F.coalesce(F.size("claims"), F.lit(0)) < 1, "claims"),
        F.when(F.exists(F.coalesce("claims", F.array().cast(f"array<{CLAIM}>")), lambda c: c["object_tag"].isin(5, 7) | ((c["object_tag"] == 1) & ~c["object_value"].isin(0, 1)) | c["subject"].isNull() | c["predicate"].isNull()), "claim value"),
        F.when(F.exists(F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")), lambda e: ~e["atom_id"].rlike(hex_) | ~F.upper(e["section_kind"]).isin(*SECTIONS)), "evidence"),
        F.when(F.col("payload").isNotNull() & F.expr("try_to_binary(payload, 'base64')").isNull(), "payload"),
    ))


def checked(atoms: DataFrame, skip_validation: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reasons)."""
    if skip_validation:
        return atoms, atoms.where("false").withColumn("problems", F.array().cast("array<string>"))
    p = atoms.withColumn("problems", problems())
    return p.where(F.size("problems") == 0).drop("problems"), p.where(F.size("problems") > 0)


def import_atoms(atoms: DataFrame, table: str, skip_validation: bool = False) -> DataFrame:
    """Appends good atoms that the table (a Parquet folder) doesn't have yet, by content id; returns the rejects."""
    spark = atoms.sparkSession
    good, bad = checked(atoms, skip_validation)
    keyed = good.withColumn("atom_id", F.coalesce(F.lower("id"), F.sha2(F.to_json(F.struct("atom_type", "claims", "evidence", "metadata", "payload")), 256))).dropDuplicates(["atom_id"])
    try:
        old = spark.read.parquet(table).select("atom_id")
    except Exception as e:  # the first import makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    (keyed if old is None else keyed.join(old, "atom_id", "left_anti")).write.mode("append").parquet(table)
    return bad


def from_base(atoms: DataFrame, claims: DataFrame) -> DataFrame:
    """Stored atoms and their claims (atom_id, subj, pred, obj) in the exchange schema; payloads as base64."""
    claim = F.struct(F.col("subj").alias("subject"), F.col("pred").alias("predicate"), F.lit(3).alias("object_tag"), F.col("obj").alias("object_value"), F.lit(0).alias("qualifiers"))
    c = claims.groupBy("atom_id").agg(F.array_sort(F.collect_set(claim)).alias("claims"))
    meta = F.struct("created_at", F.col("trust").alias("trust_level"), "domain_mask", F.col("source_id").cast("int").alias("source_id"))
    a = atoms.join(c, "atom_id", "left")
    return a.select(F.col("atom_id").alias("id"), "atom_type", F.coalesce("claims", F.array().cast(f"array<{CLAIM}>")).alias("claims"), F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), meta.alias("metadata"), F.base64(F.encode("payload", "UTF-8")).alias("payload"))


def to_base(atoms: DataFrame) -> DataFrame:
    """Atoms of the exchange schema as a base takes them; payloads are decoded."""
    claims = F.transform("claims", lambda c: F.struct(c["subject"].alias("subj"), c["predicate"].alias("pred"), c["object_value"].alias("obj")))
    text = F.coalesce(F.decode(F.unbase64("payload"), "UTF-8"), F.lit(""))
    known = lambda field, other: F.coalesce(F.col(f"metadata.{field}"), F.lit(other))
    return atoms.select(text.alias("payload"), F.upper("atom_type").alias("atom_type"), claims.alias("claims"), known("trust_level", 5000).alias("trust"), known("domain_mask", 0).alias("domain_mask"), F.col("metadata.source_id").alias("source_id"), known("created_at", 0).alias("created_at"), known("created_at", 0).alias("valid_from"))


def matches_export_filter(needle: str, *columns: str) -> Column:
    """A substring of any of the columns, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.col(c).cast("string")).contains(needle.lower())
    return out


def claim_text(c: str = "claims") -> Column:
    """subject:predicate:tag:value of each claim, for the export filter."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["subject"], x["predicate"], x["object_tag"], x["object_value"])), " ")


def export_filter(atoms: DataFrame, needle: str | None) -> DataFrame:
    """Atoms of the exchange schema with the needle in id, type, a claim, evidence or metadata."""
    if not needle:
        return atoms
    a = atoms.withColumns({"__c": claim_text(), "__e": F.to_json("evidence"), "__m": F.to_json("metadata")})
    return a.where(matches_export_filter(needle, "id", "atom_type", "__c", "__e", "__m")).drop("__c", "__e", "__m")


def csv_roundtrip(claims: DataFrame) -> DataFrame:
    """Claims (id, subj, pred, obj) grouped into atoms, written as CSV lines, parsed again and exploded."""
    atoms = claims.groupBy("id").agg(F.collect_list(F.struct(F.col("subj").alias("subject"), F.col("pred").cast("bigint").alias("predicate"), F.lit(3).alias("object_tag"), F.col("obj").alias("object_value"), F.lit(0).alias("qualifiers"))).alias("claims"))
    full = atoms.select("id", F.lit("FACT").alias("atom_type"), "claims", F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), F.struct(F.lit(0).cast("bigint").alias("created_at"), F.lit(1).alias("trust_level"), F.lit(0).cast("bigint").alias("domain_mask"), F.lit(0).alias("source_id")).alias("metadata"), F.lit(None).cast("string").alias("payload"))
    rows = csv_rows(full)
    line = F.to_csv(F.struct(*rows.columns))
    back = rows.select(F.from_csv(line, F.lit(CSV)).alias("r")).select("r.*")
    return atoms_from_csv(back).select("id", F.explode("claims").alias("c")).select("id", F.col("c.subject").alias("subj"), F.col("c.predicate").cast("int").alias("pred"), F.col("c.object_value").alias("obj"))


def save_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_num bigint, vector array<float>").parquet(path)


def save_graph(base: DataFrame, delta: DataFrame, path: str) -> None:
    """Edges by type: a typed walk reads its types only."""
    base.repartition("edge_type").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/base")
    delta.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/delta")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/delta")
