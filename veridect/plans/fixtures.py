"""Relations every query starts from, derived from the given tables.

The formulas are SQL text that means the same in Spark and in the oracle
engine: double literals carry an exponent, rounding is floor(x * s + 0.5) / s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.functions.numeric import round_half_up
from veridect.sources.listing import file_system


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(expression: str, digits: int = 6) -> str:
    """SQL text of the rounding rule."""
    return f"floor(({expression}) * 1e{digits} + 5e-1) / 1e{digits}"


def round_columns(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: round_half_up(F.col(n), digits) for n in names})


def joined_items(a: Column, digits: int = 4) -> Column:
    """An array of doubles as text of scaled integers, for comparison."""
    scale = F.lit(float(10**digits))
    return F.concat_ws(",", F.transform(a, lambda x: F.floor(x * scale + F.lit(0.5)).cast("string")))


def joined_items_sql(array: str, digits: int = 4) -> str:
    return (
        f"array_to_string(list_transform({array}, "
        f"lambda x_: CAST(CAST(floor(x_ * 1e{digits} + 5e-1) AS BIGINT) AS VARCHAR)), ',')"
    )


SIGMOID_4 = "floor((1e0 / (1e0 + exp(-({z})))) * 1e4 + 5e-1) / 1e4"
ROW_ID = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),"
    " CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING))"
)
LOGIT = (
    "floor((CAST((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 10007 AS DOUBLE) / 1.0007e4 * 6e0 - 3e0"
    " + CASE WHEN l_returnflag = 'R' THEN 8e-1 ELSE 0e0 END) * 1e4 + 5e-1) / 1e4"
)
STRATEGIES = ("baseline", "strategy_a", "strategy_b")
STRATEGY_SHIFT = (
    "CASE WHEN strategy = 'baseline' THEN 0e0"
    " WHEN strategy = 'strategy_b' THEN CASE WHEN y = 1 THEN 1.2e0 ELSE -1.2e0 END"
    " WHEN domain = 'tgt' THEN CASE WHEN y = 1 THEN 9e-1 ELSE -9e-1 END"
    " ELSE CASE WHEN y = 1 THEN -7e-1 ELSE 3e-1 END END"
)
PROGRESS_STEP = (
    "CASE event_type WHEN 'view' THEN 'frames' WHEN 'click' THEN 'frames_done' WHEN 'signup' THEN 'audio_done'"
    " WHEN 'error' THEN 'audio_error' WHEN 'purchase' THEN 'complete' END"
)
AUDIO_SCORE = (
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE floor(CAST(o_orderkey % 997 AS DOUBLE) / 9.97e2 * 1e4 + 5e-1) / 1e4 END"
)
TEXT_SCORE = "floor(CAST(o_custkey % 991 AS DOUBLE) / 9.91e2 * 1e4 + 5e-1) / 1e4"
LISTING_PATH = (
    "concat('/corpus/', CASE WHEN quality = 1 THEN 'REAL' WHEN quality = 0 THEN 'all_fakes' ELSE 'misc' END, '/', source, '/',"
    " CAST(doc_id AS STRING), CASE WHEN lang = 'en' THEN '.JPG' WHEN lang = 'de' THEN '.jpeg' WHEN lang = 'es' THEN '.png' ELSE '.txt' END)"
)
AUDIO_PATH = (
    "concat(CASE WHEN doc_id % 2 = 0 THEN '/data/for-2sec/for-2seconds/' ELSE '/data/scenefake/' END,"
    " CASE doc_id % 7 WHEN 0 THEN 'training' WHEN 1 THEN 'train' WHEN 2 THEN 'validation' WHEN 3 THEN 'dev' WHEN 4 THEN 'testing'"
    " WHEN 5 THEN 'eval' ELSE 'extra' END, '/', CASE WHEN n_chars % 3 = 0 THEN 'real' WHEN n_chars % 3 = 1 THEN 'fake' ELSE 'other' END, '/',"
    " CAST(doc_id AS STRING), CASE WHEN lang = 'en' THEN '.wav' WHEN lang = 'de' THEN '.mp3' WHEN lang = 'es' THEN '.WAV' ELSE '.flac' END)"
)

_SQL = {
    "scored": f"""
        SELECT id, video_id, frame_no, grp, domain, y, z, {SIGMOID_4.format(z='z')} AS p FROM (
          SELECT {ROW_ID} AS id, l_orderkey AS video_id, l_linenumber AS frame_no, p_brand AS grp,
                 CASE WHEN l_linestatus = 'F' THEN 'src' ELSE 'tgt' END AS domain,
                 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {LOGIT} AS z
          FROM lineitem JOIN part ON l_partkey = p_partkey) raw""",
    "strategies": f"""
        SELECT id, grp, domain, strategy, y, z, p, (y = 1) = (p > 5e-1) AS correct FROM (
          SELECT *, {SIGMOID_4.format(z='z')} AS p FROM (
            SELECT id, grp, domain, strategy, y, z + {STRATEGY_SHIFT} AS z
            FROM (SELECT id, grp, domain, y, z, unnest(['baseline', 'strategy_a', 'strategy_b']) AS strategy FROM scored) s) t) u""",
    "image_scores": f"""
        SELECT video_id, {rounded('CAST(sum(CAST(p AS DECIMAL(5,4))) AS DOUBLE) / count(*)', 4)} AS image, count(*) AS frames_analyzed
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_no, id) AS rn FROM scored) f
        WHERE rn <= 10 GROUP BY video_id""",
    "modalities": f"""
        SELECT o_orderkey AS video_id, image, {AUDIO_SCORE} AS audio,
               CASE WHEN o_orderstatus = 'P' OR o_custkey % 5 = 0 THEN NULL ELSE {TEXT_SCORE} END AS text
        FROM orders LEFT JOIN image_scores ON o_orderkey = video_id""",
    "epochs": f"""
        SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, count(*) AS n,
               {rounded("CAST(sum(CAST(least(value / 5e2, 1e0) AS DECIMAL(18,10))) AS DOUBLE) / count(*)")} AS f1
        FROM events GROUP BY event_type, CAST(day(ts) AS INT)""",
    "progress": f"SELECT event_id, user_id AS job_id, ts, {PROGRESS_STEP} AS step FROM events",
    "listing": f"""
        SELECT {LISTING_PATH} AS path, n_chars AS length FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""".replace(
        "CAST(doc_id", "CAST(d.doc_id"
    ),
    "audio_listing": f"SELECT {AUDIO_PATH} AS path FROM documents",
    "vectors": "SELECT vec_id, label, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,"
    " list_transform(embedding, lambda x_: CAST(x_ AS DOUBLE)) AS v FROM embeddings",
}
_NEEDS = {"strategies": ["scored"], "image_scores": ["scored"], "modalities": ["scored", "image_scores"]}


def with_fixtures(names: str, body: str) -> str:
    """Oracle SQL: the named relations as common table expressions, then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    ctes = ",\n".join(f"{n} AS ({_SQL[n]})" for n in wanted).replace("AS STRING)", "AS VARCHAR)")
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def scored(spark: SparkSession, sf_dir: str, grp: bool = False) -> DataFrame:
    """Scored items: id, video_id, frame_no, domain, y, z, p, and grp (the brand, from another table) if asked for."""
    items = table(spark, sf_dir, "lineitem")
    if grp:
        brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"))
        items = items.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return items.select(
        F.expr(ROW_ID).alias("id"),
        F.col("l_orderkey").alias("video_id"),
        F.col("l_linenumber").alias("frame_no"),
        *(["grp"] if grp else []),
        F.when(F.col("l_linestatus") == "F", "src").otherwise("tgt").alias("domain"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.expr(LOGIT).alias("z"),
    ).withColumn("p", F.expr(SIGMOID_4.format(z="z")))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items under three strategies, with the ``correct`` flag."""
    named = F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))
    return (
        scored(spark, sf_dir)
        .select("id", "domain", "y", "z", named.alias("strategy"))
        .withColumn("z", F.col("z") + F.expr(STRATEGY_SHIFT))
        .withColumn("p", F.expr(SIGMOID_4.format(z="z")))
        .withColumn("correct", (F.col("y") == 1) == (F.col("p") > F.lit(0.5)))
    )


def audio_text_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Videos, audio scores and ungated text scores, from orders."""
    orders = table(spark, sf_dir, "orders")
    videos = orders.select(F.col("o_orderkey").alias("video_id"))
    audio = orders.select(F.col("o_orderkey").alias("video_id"), F.expr(AUDIO_SCORE).alias("score"))
    text = orders.select(
        F.col("o_orderkey").alias("video_id"),
        F.when(F.col("o_custkey") % 5 != 0, F.expr(TEXT_SCORE)).alias("score"),
    )
    return videos, audio, text


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch log: run, epoch, n, f1."""
    events = table(spark, sf_dir, "events")
    share = F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).cast("decimal(18,10)")
    return (
        events.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(share).cast("double").alias("_s"))
        .select("run", "epoch", "n", round_half_up(F.col("_s") / F.col("n"), 6).alias("f1"))
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job progress events: event_id, job_id, ts, step."""
    return progress_events(table(spark, sf_dir, "events"))


def instant(df: DataFrame, name: str) -> Column:
    """A wall-clock column read as UTC, whatever the session's zone; instants stay as they are."""
    if df.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.col(name)
    return F.expr(
        f"timestamp_micros(unix_date(cast({name} AS date)) * 86400000000L + hour({name}) * 3600000000L"
        f" + minute({name}) * 60000000L + cast(extract(SECOND FROM {name}) * 1000000 AS bigint))"
    )


def progress_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").alias("job_id"), instant(events, "ts").alias("ts"), F.expr(PROGRESS_STEP).alias("step")
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-like listing of documents below /corpus."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.expr(LISTING_PATH).alias("path"), F.col("n_chars").alias("length")
    )


def audio_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(AUDIO_PATH).alias("path"))


def write_tree(files: DataFrame, root: str) -> None:
    """Writes (path, content) rows as files below ``root``, from the tasks; paths begin with a slash."""

    def write(batches):
        system, top = file_system(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                system.create_dir((top + path).rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(top + path) as out:
                    out.write(content)
        yield from ()

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature arrays: vec_id, label, y, v."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.when(F.col("label") < 5, 1).otherwise(0).alias("y"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
