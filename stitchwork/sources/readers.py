"""Sources: image folders, tolerant JSON lines, JSON maps, CSV/TSV shards, trees, listings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchwork.functions import jsonish
from stitchwork.functions.text import strip
from stitchwork.functions.urls import with_media_urls
from stitchwork.operators.filters import keep, usable_labels
from stitchwork.rules import garments as G
from stitchwork.rules import routing as R


def _glob(extensions: list[str]) -> str:
    """Case-insensitive file-name glob."""
    either = lambda ch: f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch
    return "*{" + ",".join("".join(either(c) for c in e) for e in extensions) + "}"


def image_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Path and size of every image below a folder; contents are never read.

    Hidden, empty and unfinished files are left out.
    """
    extensions = extensions or R.IMAGE_EXTENSIONS
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", _glob(extensions)).load(root).select("path", "length", "modificationTime"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("filename"), "length", "modificationTime").where(
        (F.col("length") > 0) & ~F.col("filename").startswith(".") & ~F.lower("filename").endswith(".tmp"))


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; one that does not decode stays as a row with height -1."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    return images.select(F.substring_index("image.origin", "/", -1).alias("filename"), "image.height", "image.width",
                         "image.nChannels", "image.data")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Typed JSON lines; blank and broken lines are skipped."""
    parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType(parsed.fields + [T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same tolerance for JSON text inside a table: unparseable rows go."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_p", parsed).where(F.col("_p").isNotNull()).select(*df.columns, "_p.*")


def json_map_rows(texts: DataFrame, key: str = "category", value: str = "url") -> DataFrame:
    """``{category: [url, ...]}`` documents (``value``) as rows with the position inside the list."""
    entries = texts.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, "_list"))
    return entries.select(key, F.posexplode("_list").alias("position", value))


def json_map_of_lists(spark: SparkSession, path: str, key: str = "category", value: str = "url") -> DataFrame:
    return json_map_rows(spark.read.text(path, wholetext=True), key, value)


def manifest_rows(texts: DataFrame) -> DataFrame:
    """``{filename: {prompt, category, tier, seed, row}}`` documents (``value``) as rows."""
    kind = ("map<string,struct<prompt:string,negative_prompt:string,category:string,tier:string,seed:bigint,"
            "row:map<string,string>>>")
    return texts.select(F.explode(F.from_json("value", kind)).alias("filename", "_e")).select("filename", "_e.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path, wholetext=True))


def variant_rows(texts: DataFrame) -> DataFrame:
    """``{variant: {key: text}}`` documents (``value``) as (variant, key, text), empty texts left out."""
    outer = texts.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("variant", "_m"))
    return outer.select("variant", F.explode("_m").alias("key", "text")).where(F.col("text") != "")


def variants(spark: SparkSession, path: str) -> DataFrame:
    return variant_rows(spark.read.text(path, wholetext=True))


def label_type(field: dict) -> T.DataType:
    return {"regression": T.DoubleType(), "ordinal": T.IntegerType()}.get(field["type"], T.StringType())


def spark_schema(fields: list[dict]) -> T.StructType:
    """Typed label schema; classes and loss weight live in the field metadata."""
    keep = lambda f: {k: v for k, v in f.items() if k != "name"}
    return T.StructType([T.StructField(f["name"], label_type(f), True, keep(f)) for f in fields])


def schema_file(path: str) -> T.StructType:
    """Label schema from a schema file on any file system that Spark reads, provenance-only fields dropped."""
    text = SparkSession.active().read.text(path, wholetext=True).first()[0]
    return spark_schema(trainable_fields(json.loads(text)))


def trainable_fields(fields: list[dict]) -> list[dict]:
    return [f for f in fields if f["type"] != "meta"]


def labels_csv(spark: SparkSession, path: str | list[str], category: str | None = None) -> DataFrame:
    """Header CSV as text, typed by the category's label schema where one is given; blanks become null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if category is None:
        return raw
    kinds = {f["name"]: label_type(f) for f in G.label_schema(category)}
    typed = [F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns]
    return raw.select(*typed)


def shards(spark: SparkSession, pattern: str, kind: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """Shard files with the shard each row came from."""
    if kind == "csv":
        rows = spark.read.option("header", True).csv(pattern)
    else:
        rows = json_lines(spark, pattern, schema)
    return rows.select("*", F.col("_metadata.file_name").alias("shard"))


def tsv(spark: SparkSession, folder: str, names: list[str], columns: list[str]) -> DataFrame:
    """First existing file of several possible names, only the asked columns."""
    from py4j.protocol import Py4JJavaError  # raised by path checks on some file systems

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        path = hadoop(f"{folder}/{name}")
        try:
            found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        except Py4JJavaError:
            found = False
        if found:
            return spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/{name}").select(*columns)
    raise FileNotFoundError(f"none of {names} in {folder}")


def parquet_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Image shards with a nested image struct; unreadable shards and empty images are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*paths)
    return rows.where(F.col("image.bytes").isNotNull() & (F.octet_length("image.bytes") > 0))


def shard_ledger(spark: SparkSession, root: str, manifest: DataFrame, schema: T.StructType | str,
                 usable: Column | None = None) -> DataFrame:
    """What became of each shard that ``manifest`` (shard, rows) names, and of any other below ``root``.

    shard, files, bytes, expected, read, usable, status. A shard is the first
    folder or file name below ``root``. ``expected`` is the manifest's number or, where that is null,
    what the files' footers say; ``read`` are the rows whose columns could all be decoded. A broken file ends at its
    first unreadable part and doesn't stop the others. Status: missing (no file), failed (files, but no row of those
    expected), partial (fewer rows than expected), excess (more), unlisted (not in the manifest), else complete.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    shard = lambda path: F.regexp_extract(F.url_decode(path), f"(?:^|:/*){_literal(base)}/([^/]+)", 1)
    reader = spark.read.option("recursiveFileLookup", True)
    files = (reader.format("binaryFile").load(root).select(shard(F.col("path")).alias("shard"), F.col("path"), F.col("length"))
             .where(~F.substring_index("path", "/", -1).rlike("^[_.]")).groupBy("shard")
             .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))
    rows = reader.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(root)
    located = rows.select("*", shard(F.col("_metadata.file_path")).alias("_shard"))
    whole = F.xxhash64(*rows.columns)  # reads every column
    good = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    seen = located.groupBy(F.col("_shard").alias("shard")).agg(F.count(whole).alias("read"), F.count_if(good).alias("usable"))
    footers = (rows.select(shard(F.col("_metadata.file_path")).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("_footer")))
    listed = manifest.groupBy("shard").agg(F.sum("rows").cast("long").alias("_listed")).withColumn("_known", F.lit(True))
    out = listed.join(files, "shard", "full").join(footers, "shard", "left").join(seen, "shard", "left")
    n, read = F.coalesce("_listed", "_footer"), F.coalesce("read", F.lit(0))
    status = (F.when(F.col("files").isNull(), "missing").when(F.col("_known").isNull(), "unlisted")
              .when((read == 0) & (n.isNull() | (n > 0)), "failed").when(read < n, "partial").when(read > n, "excess").otherwise("complete"))
    return out.select("shard", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
                      n.alias("expected"), read.alias("read"), F.coalesce("usable", F.lit(0)).alias("usable"), status.alias("status"))


def _literal(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip("value").alias("line")).where(F.col("line") != "")


def partition_tree(spark: SparkSession, root: str) -> DataFrame:
    """Image files with stream, demographic and tier taken from their folders."""
    parts = F.split("path", "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return image_files(spark, root).select("path", "filename", at(-4).alias("stream"), at(-3).alias("demographic"),
                                           at(-2).alias("tier"))


def discover_labels(spark: SparkSession, category: str, preferred: str, fallback: str) -> dict:
    """Measured labels if they exist, else plain ones, else nothing but a warning.

    Only paths are checked here; the returned ``rows`` stay a lazy frame.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def exists(path: str) -> bool:
        p = hadoop(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def find(base: str):
        images = [f"{b}/images" for b in (base, fallback) if exists(f"{b}/images")]
        files = [f"{base}/labels_{category}{s}.csv" for s in ("_measured", "") if exists(f"{base}/labels_{category}{s}.csv")]
        return (files[0], images[0]) if exists(base) and files and images else None

    warning, source, found = None, "qa_processed", find(preferred)
    if found is None:
        source, found = "raw_generated", find(fallback)
        if found is None:
            return {"available": False, "source": None, "rows": None, "images": None,
                    "warning": f"{category}: no synthetic data found, 0 images available"}
        warning = f"{category}: no measured labels, falling back to unfiltered raw labels"
    rows = usable_labels(labels_csv(spark, found[0]), source)
    return {"available": True, "source": source, "rows": rows, "images": found[1], "warning": warning}


def batch_predictions(lines: DataFrame, text: str = "value", repair: bool = True) -> DataFrame:
    """Answers of a prediction batch; lines without a usable answer stay as ``parse_failure`` rows."""
    answer = F.get_json_object(text, "$.response.candidates[0].content.parts[0].text")
    parse = jsonish.repair_json if repair else jsonish.parse_verdict
    out = lines.where(strip(F.col(text)) != "").select(
        F.get_json_object(text, "$.key").alias("key"), parse(answer).alias("result"))
    return out.withColumn("error", F.when(F.col("result").isNull(), "parse_failure"))


POST_SCHEMA = (
    "id string, title string, selftext string, url string, url_overridden_by_dest string, domain string, "
    "post_hint string, is_video boolean, is_gallery boolean, removed_by_category string, "
    "gallery_data struct<items:array<struct<media_id:string>>>, "
    "media_metadata map<string,struct<status:string,s:struct<u:string,gif:string,x:int,y:int>,p:array<struct<u:string>>>>, "
    "preview struct<images:array<struct<source:struct<url:string,width:int,height:int>>>>")
LISTING_SCHEMA = f"data struct<after:string,children:array<struct<kind:string,data:struct<{POST_SCHEMA.replace(' string', ':string').replace(' boolean', ':boolean').replace(' struct<', ':struct<').replace(' map<', ':map<')}>>>>"


def listing_pages(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Landed listing pages (one JSON document per line) as a batch or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LISTING_SCHEMA).json(folder)


def listing_urls(pages: DataFrame, page: Column) -> DataFrame:
    """Image URLs of listing pages in order of appearance, one row per first appearance in the page."""
    posts = pages.select(page.alias("page"), F.posexplode("data.children").alias("post_pos", "child"))
    own = posts.where(F.col("child.kind") == "t3").select("page", "post_pos", F.col("child.data").alias("post"))
    found = keep(with_media_urls(own, "post"), F.size("urls") > 0)
    urls = found.select("page", "post_pos", F.posexplode("urls").alias("url_pos", "url"))
    first = urls.groupBy("page", "url").agg(F.min(F.struct("post_pos", "url_pos")).alias("at"))
    return first.select("page", "at.post_pos", "at.url_pos", "url")


def catalog_columns(value: Column) -> dict[str, Column]:
    """Category, subreddit, query and limit of one catalog entry (JSON text).

    An object uses its own fields with their alternative names, a string
    names the subreddit.
    """
    j = lambda name: F.get_json_object(value, f"$.{name}")
    present = lambda c: F.when(c != "", c)
    is_object = value.startswith("{")
    name = F.btrim(value, F.lit('"'))
    bare = F.btrim(F.replace(name, F.lit("r/"), F.lit("")), F.lit("/"))
    return {
        "category": F.when(is_object, F.coalesce(present(j("category")), present(j("folder")), present(j("name"))))
        .otherwise(F.concat(F.lit("reddit_"), bare)),
        "subreddit": F.when(is_object, F.coalesce(present(j("subreddit")), present(j("target")), present(j("url"))))
        .otherwise(name),
        "query": F.when(is_object, j("query")), "limit": F.when(is_object, j("limit")).cast("int")}


def normalize_catalog(rows: DataFrame) -> DataFrame:
    """Catalog input lines (``value``: one JSON value each) as catalog rows."""
    return rows.select(*[v.alias(k) for k, v in catalog_columns(F.col("value")).items()])


def normalize_catalog_map(rows: DataFrame) -> DataFrame:
    """A whole catalog object (``value``): each entry is a subreddit name or a spec of its own."""
    entries = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("_key", "_spec"))
    spec = F.col("_spec").startswith("{")
    j = lambda name: F.when(spec, F.get_json_object("_spec", f"$.{name}"))
    return entries.select(F.coalesce(j("category"), F.col("_key")).alias("category"),
                          F.when(spec, j("subreddit")).otherwise(F.col("_spec")).alias("subreddit"),
                          j("query").alias("query"), j("limit").cast("int").alias("limit"))


CATALOG_SCHEMA = ("category string, subreddit string, query string, listing string, sort string, time string, "
                  "description string, limit int")


def catalog_defaults(rows: DataFrame) -> DataFrame:
    """Fill a catalog table: a query and a listing exclude each other, the rest has defaults."""
    query = F.when(F.col("query") != "", F.col("query"))
    return rows.withColumns({
        "query": query, "listing": F.when(query.isNull(), F.coalesce("listing", F.lit("hot"))),
        "sort": F.coalesce("sort", F.lit("top")), "time": F.coalesce("time", F.lit("all")),
        "description": F.coalesce("description", F.lit("")), "limit": F.coalesce("limit", F.lit(40))})


def query_catalog(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Declarative catalog with defaults; a query and a listing exclude each other."""
    names = [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]
    return catalog_defaults(spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], CATALOG_SCHEMA))
