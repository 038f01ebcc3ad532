"""Readers of the engine's tables and of files in the shapes it meets (inventory S4-S17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "id string, canonical_name string, name string, type string, description string, aliases array<string>, attributes map<string,string>, confidence double, evidence string, source_pages array<int>, source_chunks array<int>, frequency long"
RELATIONSHIP = "source string, relation string, target string, description string, confidence double, evidence string, implicit boolean, source_pages array<int>, source_chunks array<int>, frequency long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, text) of a JSON array of pages; pages without text go."""
    return spark.read.schema("page int, text string").option("recursiveFileLookup", "true").json(path, multiLine=True).where("text is not null and text <> ''")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a merged graph file."""
    g = spark.read.schema(f"entities array<struct<{_struct(ENTITY)}>>, relationships array<struct<{_struct(RELATIONSHIP)}>>").json(path, multiLine=True)
    return g.select(F.explode("entities").alias("e")).select("e.*"), g.select(F.explode("relationships").alias("r")).select("r.*")


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, entities, relationships) of a folder of chunk_N.json files."""
    g = spark.read.schema(f"entities array<struct<{_struct(ENTITY)}>>, relationships array<struct<{_struct(RELATIONSHIP)}>>").json(path, multiLine=True)
    return g.select(F.regexp_extract(F.input_file_name(), r"chunk_(-?\d+)\.json", 1).try_cast("int").alias("chunk_id"), "entities", "relationships")


def _struct(ddl: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in _fields(ddl))


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, question, ground_truth); difficulty and answer are other names of two of these."""
    q = spark.read.schema("id int, category string, difficulty string, question string, ground_truth string, answer string").option("recursiveFileLookup", "true").json(path, multiLine=True)
    return q.select("id", F.coalesce("category", "difficulty").alias("category"), "question", F.coalesce("ground_truth", "answer").alias("ground_truth"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks whose text goes by any of four names."""
    c = spark.read.schema("chunk_id int, text string, content string, chunk_text string, text_preview string, page_start int, page_end int, section_title string, char_count int").option("recursiveFileLookup", "true").json(path, multiLine=True)
    return c.select("chunk_id", F.coalesce("text", "content", "chunk_text", "text_preview").alias("text"), "page_start", "page_end", "section_title", "char_count")


def read_log(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(line, event, value): lines that match a named pattern, with its first group."""
    t = spark.read.text(path).withColumnRenamed("value", "line")
    hits = [F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("event"), F.regexp_extract("line", p, 1).alias("value"))) for n, p in patterns.items()]
    return t.select("line", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("line", "h.event", "h.value")


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means of a CSV's numeric columns."""
    return df.agg(*(F.round(F.avg(F.col(c).try_cast("double")), 6).alias(c) for c in columns))


def latest_block(summary: DataFrame, suffix: str = "_graph_metrics") -> DataFrame:
    """(version, metrics) of a summary's highest vN block."""
    names = [c for c in summary.columns if c.endswith(suffix)]
    blocks = F.explode(F.array(*(F.struct(F.regexp_extract(F.lit(c), r"^v(\d+)", 1).cast("int").alias("version"), F.to_json(c).alias("metrics")) for c in names)))
    return summary.select(blocks.alias("b")).agg(F.max("b.version").alias("version"), F.max_by("b.metrics", "b.version").alias("metrics"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, digest): the first 16 hex digits of each file's SHA-256."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), digest(F.col("content")).alias("digest"))


def digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def write_json(df: DataFrame, path: str) -> None:
    """S10"""
    df.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, wrap: str | None = None, rows: int = 10_000) -> None:
    """Files of one JSON array of at most about `rows` rows each; wrap names the field of an object around it."""
    many = max(1, -(-df.count() // rows))
    dealt = df.select(F.struct(*df.columns).alias("row"), F.pmod(F.xxhash64(*df.columns[:1]), F.lit(many)).alias("b"))
    rows_ = dealt.groupBy("b").agg(F.collect_list("row").alias(wrap or "rows"))
    body = F.to_json(F.struct(wrap)) if wrap else F.to_json("rows")
    rows_.repartition(many, "b").select("b", body.alias("value")).write.mode("overwrite").partitionBy("b").text(path)


def read_graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, type, page) of the nodes of a graph file of the other dialect: typed, with properties."""
    schema = "nodes array<struct<id:string, type:string, properties:struct<name:string, page:int>>>"
    g = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path, multiLine=True)
    return g.select(F.explode("nodes").alias("n")).select("n.id", "n.properties.name", "n.type", "n.properties.page")


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("multiLine", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that new ones don't replace, and the new ones, one for each key."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def write_vectors(df: DataFrame, path: str, parts: int) -> None:
    """Vectors as parquet in parts by id, so that blocks of ids are read together."""
    df.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Vectors of a store, or those of a range of ids, whose bounds reach the scan."""
    v = spark.read.parquet(path)
    v = v if first is None else v.where(F.col("vec_id") >= first)
    return v if last is None else v.where(F.col("vec_id") <= last)
