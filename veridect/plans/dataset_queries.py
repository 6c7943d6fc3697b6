"""Manifest, label, sampling, array and table-IO queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridect.functions import arrays as A
from veridect.functions.decisions import binary_label, is_correct
from veridect.functions.numeric import round_half_up
from veridect.operators import labels as B
from veridect.operators import sampling as S
from veridect.operators.features import global_standardize
from veridect.plans import fixtures as X
from veridect.plans.evaluation_queries import SPLIT_CTES
from veridect.plans.fixtures import joined_items, joined_items_sql, round_columns, rounded, table, with_fixtures
from veridect.plans.registry import query
from veridect.session import scratch_path
from veridect.sources import images, manifests, tables
from veridect.sources.listing import list_tree

SEED = 42


# ---- sources ---------------------------------------------------------------


@query("src_image_manifest", with_fixtures("listing", """
SELECT path, length, lower(path) AS sort_key, lower(string_split(path, '/')[-1]) AS name_key
FROM listing WHERE regexp_matches(path, '(?i)[^/]\\.(jpg|jpeg|png)$')"""))
def src_image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files as long as the documents, written and then listed folder by folder."""
    root = scratch_path(spark, "tree")
    listed = X.listing(spark, sf_dir)
    X.write_tree(listed.select("path", F.repeat(F.lit("x"), F.col("length").cast("int")).cast("binary").alias("content")), root)
    below = _relative(list_tree(spark, root), root)
    return manifests.image_manifest(below).withColumn("name_key", F.lower(manifests.file_name(F.col("path"))))


def _relative(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("path", F.substring("path", F.lit(len(root.rstrip("/")) + 1), F.length("path")))


@query("src_label_from_dir", with_fixtures("listing", """
SELECT path, CASE WHEN path LIKE '/corpus/REAL/%' THEN 'real' WHEN path LIKE '/corpus/all\\_fakes/%' ESCAPE '\\' THEN 'fake' END AS label,
       CASE WHEN path LIKE '/corpus/REAL/%' THEN 'real' END AS strict_label FROM listing"""))
def src_label_from_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.labels_from_dir(X.listing(spark, sf_dir).select("path"), "/corpus")


@query("src_audio_manifest", with_fixtures("audio_listing", """
SELECT path AS file_path, regexp_extract(path, '/(real|fake)/[^/]+$', 1) AS label, 'FakeOrReal' AS source,
       regexp_extract(path, '^/data/for-2sec/for-2seconds/([a-z]+)/', 1) AS split
FROM audio_listing WHERE regexp_matches(path, '^/data/for-2sec/for-2seconds/(training|validation|testing)/(real|fake)/[^/]*\\.(wav|mp3|flac)$')
UNION ALL
SELECT path, regexp_extract(path, '/(real|fake)/[^/]+$', 1), 'SceneFake',
       CASE regexp_extract(path, '^/data/scenefake/([a-z]+)/', 1) WHEN 'train' THEN 'training' WHEN 'dev' THEN 'validation' ELSE 'testing' END
FROM audio_listing WHERE regexp_matches(path, '^/data/scenefake/(train|dev|eval)/(real|fake)/[^/]*\\.(wav|mp3|flac)$')"""))
def src_audio_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.audio_manifest(X.audio_listing(spark, sf_dir), "/data", "/data/scenefake")


@query("src_audio_discovery", with_fixtures(
    "audio_listing", "SELECT path FROM audio_listing WHERE regexp_matches(path, '[^/]\\.(wav|mp3|flac|m4a|ogg)$')"))
def src_audio_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of empty files, written and then listed folder by folder."""
    root = scratch_path(spark, "tree")
    X.write_tree(X.audio_listing(spark, sf_dir).withColumn("content", F.lit(b"")), root)
    return manifests.audio_discovery(_relative(list_tree(spark, root), root)).select("path")


_SPLIT_OF = "CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'valid' ELSE 'test' END"
_SPLIT_ROWS = f"""SELECT 'doc/' || CAST(d.doc_id AS VARCHAR) AS filepath, CAST(1 - quality AS INT) AS target,
       CASE WHEN lang = 'es' THEN NULL ELSE CAST(n_chars AS DOUBLE) / 1e3 END AS skip_time, source AS source_platform, {_SPLIT_OF} AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("filepath"),
        (F.lit(1) - F.col("quality")).alias("target"),
        F.when(F.col("lang") != "es", F.col("n_chars").cast("double") / F.lit(1000.0)).alias("skip_time"),
        F.col("source").alias("source_platform"),
        F.expr(_SPLIT_OF).alias("split"),
    )


@query("src_split_csv", _SPLIT_ROWS)
def src_split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split files are written from the tables, then read back."""
    rows, root = split_rows(spark, sf_dir), scratch_path(spark, "splits")
    rows.write.partitionBy("split").option("header", True).csv(root)
    return tables.read_split_files(spark, {n: f"{root}/split={n}" for n in ("train", "valid", "test")})


@query("src_eval_parquet", """
SELECT CASE WHEN e.label < 5 THEN 1 ELSE 0 END AS label, 'generator-' || CAST(e.label AS VARCHAR) AS model_name, count(*) AS rows,
       count(*) FILTER (WHERE e.label <> 7) AS readable FROM embeddings e GROUP BY e.label""")
def src_eval_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of (image_data, label, model_name, extra): rows and readable images of each generator."""
    root = scratch_path(spark, "shards")
    encoded_images(spark, sf_dir).withColumn("extra", F.lit("unused")).write.parquet(root)
    checked = images.image_metadata(tables.read_eval_shards(spark, root), "image_data")
    return checked.groupBy("label", "model_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("readable"))


def encoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG signatures and headers made from the embedding table, one per row.

    Width and height follow from the row; every eighth label is left unreadable.
    """

    def big_endian(x, digits: int):
        return F.lpad(F.hex(x), digits, "0")

    width, height = F.lit(64) + F.col("vec_id") % 32, F.lit(32) + F.col("label")
    header = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"),
        big_endian(width, 8),
        big_endian(height, 8),
        F.lit("08"),
        F.when(F.col("label") % 2 == 0, "02").otherwise("00"),
        F.lit("000000"),
        F.hex(F.array_join(F.col("embedding"), ",")),
    )
    data = F.when(F.col("label") == 7, F.unhex(F.lit("00FF"))).otherwise(F.unhex(header))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        data.alias("image_data"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
        F.concat(F.lit("generator-"), F.col("label").cast("string")).alias("model_name"),
    )


@query("src_image_metadata", """
SELECT vec_id, CASE WHEN label <> 7 THEN 'PNG' END AS format, CASE WHEN label = 7 THEN NULL WHEN label % 2 = 0 THEN 'RGB' ELSE 'L' END AS mode,
       CASE WHEN label <> 7 THEN CAST(64 + vec_id % 32 AS INT) END AS width, CASE WHEN label <> 7 THEN CAST(32 + label AS INT) END AS height,
       label <> 7 AS valid FROM embeddings""")
def src_image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_metadata(encoded_images(spark, sf_dir).select("vec_id", "image_data"), "image_data")


@query("src_image_headers", """
SELECT '/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) AS path, CASE WHEN label = 7 THEN NULL WHEN label % 3 = 1 THEN 'JPEG' ELSE 'PNG' END AS format,
       CASE WHEN label = 7 THEN NULL WHEN label % 3 = 1 OR label % 2 = 0 THEN 'RGB' ELSE 'L' END AS mode,
       CASE WHEN label <> 7 THEN CAST(64 + vec_id % 32 AS INT) END AS width, CASE WHEN label <> 7 THEN CAST(32 + label AS INT) END AS height,
       label <> 7 AS valid, CASE WHEN label = 7 THEN 2 WHEN label % 3 = 1 THEN 46 ELSE 26 END AS bytes_read FROM embeddings""")
def src_image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG and JPEG files written as a tree, listed, and read at the places where their headers stand."""
    root = scratch_path(spark, "images")
    jpeg = (F.col("label") % 3 == 1) & (F.col("label") != 7)
    width, height = F.lit(64) + F.col("vec_id") % 32, F.lit(32) + F.col("label")
    # an application segment of 4,000 bytes stands before the frame header
    frame = F.concat(F.lit("FFC0001108"), F.lpad(F.hex(height), 4, "0"), F.lpad(F.hex(width), 4, "0"), F.lit("03"), F.lit("00" * 9))
    as_jpeg = F.unhex(F.concat(F.lit("FFD8FFE10FA2" + "00" * 4000), frame, F.lit("FFD9")))
    pictures = encoded_images(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("kind")), "vec_id")
    rows = pictures.select("vec_id", F.col("kind").alias("label"), "image_data")
    place = F.concat(F.lit("/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"))
    X.write_tree(rows.select(place.alias("path"), F.when(jpeg, as_jpeg).otherwise(F.col("image_data")).alias("content")), root)
    return _relative(images.read_headers(list_tree(spark, root), root), root).drop("length")


@query("src_latest_snapshot", """
SELECT event_id, user_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)""")
def src_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "snapshots")
    events = table(spark, sf_dir, "events").withColumn("snapshot", F.date_format("ts", "yyyy-MM-dd"))
    events.hint("rebalance", "snapshot").write.partitionBy("snapshot").parquet(root)
    return tables.read_latest_snapshot(spark, root).select("event_id", "user_id", "event_type")


@query("src_predictions_csv", with_fixtures("scored", """
SELECT id AS file, CASE WHEN y = 1 THEN 'FAKE' ELSE 'REAL' END AS true_label, p AS fake_prob, CASE WHEN frame_no % 2 = 1 THEN floor((1e0 - p) * 1e4 + 5e-1) / 1e4 END AS real_prob,
       CASE WHEN p > 5e-1 THEN 'FAKE' ELSE 'REAL' END AS pred_label, (y = 1) = (p > 5e-1) AS correct FROM scored WHERE frame_no <> 7"""))
def src_predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of six columns, and of five in another order; seventh frames carry no usable score."""
    root = scratch_path(spark, "predictions")
    rows = _prediction_texts(spark, sf_dir)
    odd = F.col("frame_no") % 2 == 1
    rows.filter(odd).select(*_SIX_COLUMNS).write.option("header", True).csv(f"{root}/run=a")
    rows.filter(~odd).select("correct", "pred_label", "file", "fake_prob", "true_label").write.option("header", True).csv(f"{root}/run=b")
    return tables.read_predictions(spark, root)


_SIX_COLUMNS = ("file", "true_label", "fake_prob", "real_prob", "pred_label", "correct")


def _prediction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scored(spark, sf_dir).select(
        "frame_no",
        F.col("id").alias("file"),
        F.lower(B.label_text(F.col("y"))).alias("true_label"),
        F.when(F.col("frame_no") == 7, "n/a").otherwise(F.col("p").cast("string")).alias("fake_prob"),
        round_half_up(F.lit(1.0) - F.col("p"), 4).cast("string").alias("real_prob"),
        binary_label(F.col("p")).alias("pred_label"),
        F.initcap(is_correct(F.col("p"), F.col("y")).cast("string")).alias("correct"),
    )


@query("src_csv_rejected", with_fixtures("scored", """
SELECT CASE frame_no WHEN 2 THEN '5 cells where the header has 6' WHEN 3 THEN '7 cells where the header has 6' WHEN 4 THEN 'open quote' END AS reason,
       string_split(id, '-')[1] AS item, count(*) AS records FROM scored WHERE frame_no BETWEEN 2 AND 4 GROUP BY ALL"""))
def src_csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not fit their header, set aside: of the predictions, those written with a cell too few or too many or an open quote."""
    root = scratch_path(spark, "ragged")
    rows = _prediction_texts(spark, sf_dir)
    line = F.concat_ws(",", *_SIX_COLUMNS)
    broken = (
        F.when(F.col("frame_no") == 2, F.concat_ws(",", *_SIX_COLUMNS[:-1]))
        .when(F.col("frame_no") == 3, F.concat(line, F.lit(",more")))
        .when(F.col("frame_no") == 4, F.concat(line, F.lit('"')))
        .otherwise(line)
    )
    # a header to each file, as each task writes one
    with_header = F.when(F.col("place") == 0, F.concat(F.lit(",".join(_SIX_COLUMNS) + "\n"), broken)).otherwise(broken)
    placed = rows.withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed.select(with_header.alias("value")).write.text(root)
    rejected = tables.prediction_files(spark, root).rejected
    return rejected.groupBy("reason", F.split("record", "-")[0].alias("item")).agg(F.count(F.lit(1)).alias("records"))


@query("src_result_coalesce", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'fake' WHEN 'click' THEN 'real' ELSE 'UNKNOWN' END AS prediction,
       CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value / 2e0 WHEN 'signup' THEN value ELSE NULL END AS prob_fake FROM events""")
def src_result_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result objects of three shapes, and of none, built from the events."""
    kind, value = F.col("event_type"), F.col("value")
    shaped = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", F.to_json(F.struct(F.lit("fake").alias("prediction"), F.lit("x").alias("label"), value.alias("prob_fake"))))
        .when(kind == "click", F.to_json(F.struct(F.lit("real").alias("label"), (value / F.lit(2.0)).alias("fake_probability"))))
        .when(kind == "signup", F.to_json(F.struct(value.alias("score"))))
        .otherwise(F.to_json(F.struct(F.lit("high").alias("score"))))
        .alias("result"),
    )
    return tables.coalesce_results(shaped, "result").drop("result")


# ---- labels and filters ----------------------------------------------------


@query("prj_label_encode", """
SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS fake_positive, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS real_positive,
       CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS domain_code FROM labels""")
def prj_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 0, "Fake").otherwise("REAL").alias("label"),
        F.when(F.col("toxic") == 1, "diffusion").otherwise("GAN").alias("domain"),
    )
    return named.select(
        "doc_id",
        B.fake_positive(F.col("label")).alias("fake_positive"),
        B.real_positive(F.col("label")).alias("real_positive"),
        B.domain_code(F.col("domain")).alias("domain_code"),
    )


@query("prj_split_filter", f"SELECT filepath, target, split FROM ({_SPLIT_ROWS}) r WHERE split = 'train'")
def prj_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_rows(split_rows(spark, sf_dir), "train").select("filepath", "target", "split")


@query("prj_target_counts", f"""
SELECT split, count(*) AS num_rows, count(*) FILTER (WHERE target = 0) AS num_real, count(*) FILTER (WHERE target = 1) AS num_fake
FROM ({_SPLIT_ROWS}) r GROUP BY split""")
def prj_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.target_counts(split_rows(spark, sf_dir), y="target")


@query("prj_pair_real_fake", with_fixtures(
    "listing", "SELECT path, CASE WHEN path LIKE '/corpus/REAL/%' THEN 0 ELSE 1 END AS y FROM listing WHERE path NOT LIKE '/corpus/misc/%'"))
def prj_pair_real_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.listing(spark, sf_dir).select("path")
    real = files.filter(F.col("path").startswith("/corpus/REAL/"))
    fake = files.filter(F.col("path").startswith("/corpus/all_fakes/"))
    return B.pair_real_fake(real, fake)


@query("qc_score_contract", """
WITH long AS (
  SELECT event_type AS modality, value / 5e2 AS score, CASE WHEN event_type = 'error' THEN 'MAYBE' WHEN value > 2.5e2 THEN 'FAKE' ELSE 'REAL' END AS label FROM events)
SELECT modality, rows, rule, violations FROM (
  SELECT modality, count(*) AS rows, count(*) FILTER (WHERE score IS NULL) AS score_missing,
         count(*) FILTER (WHERE score < 0e0 OR score > 1e0) AS score_out_of_range,
         count(*) FILTER (WHERE label NOT IN ('FAKE', 'REAL')) AS label_not_allowed FROM long GROUP BY modality) w
UNPIVOT (violations FOR rule IN (score_missing, score_out_of_range, label_not_allowed))""")
def qc_score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("modality"),
        (F.col("value") / F.lit(500.0)).alias("score"),
        F.when(F.col("event_type") == "error", "MAYBE").when(F.col("value") > 250.0, "FAKE").otherwise("REAL").alias("label"),
    )
    return B.score_contract(results, "modality", "score", "label")


# ---- sampling --------------------------------------------------------------


def _rank(keys: str) -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY md5(id || ':42'), id)"


@query("smp_per_class_n", with_fixtures("scored", f"""
SELECT id, y FROM (SELECT id, y, {_rank('y')} AS rk FROM scored) r WHERE rk <= 50"""))
def smp_per_class_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_per_class(X.scored(spark, sf_dir).select("id", "y"), ["y"], "id", 50, SEED)


@query("smp_train_val_disjoint", with_fixtures("scored", f"""
SELECT id, y, CASE WHEN rk <= 3000 THEN 'train' ELSE 'val' END AS subset
FROM (SELECT id, y, {_rank('y')} AS rk FROM scored) r WHERE rk <= 3500"""))
def smp_train_val_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.train_val_per_class(X.scored(spark, sf_dir).select("id", "y"), ["y"], "id", 3000, 500, SEED)


@query("smp_domain_class", with_fixtures("scored", f"""
SELECT id, y, domain, CASE WHEN rk <= 2000 THEN 'train' ELSE 'val' END AS subset
FROM (SELECT id, y, domain, {_rank('domain, y')} AS rk FROM scored) r WHERE rk <= 2400"""))
def smp_domain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and class quotas; both subsets come from one table, so they follow each other."""
    rows = X.scored(spark, sf_dir).select("id", "y", "domain")
    return S.train_val_per_class(rows, ["domain", "y"], "id", 2000, 400, SEED)


@query("smp_uniform_n", with_fixtures("scored", """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS rk FROM scored) r WHERE rk <= 2000"""))
def smp_uniform_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_uniform(X.scored(spark, sf_dir).select("id"), "id", 2000, SEED)


@query("smp_stratified_split", with_fixtures("scored", f"WITH {SPLIT_CTES} SELECT id, y, split FROM halves"))
def smp_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(X.scored(spark, sf_dir).select("id", "y"), "y", "id", 0.2, SEED)


@query("smp_oversample", with_fixtures("scored", f"""
WITH src AS (SELECT id, y, domain, {_rank('y')} - 1 AS idx FROM scored),
sizes AS (SELECT y, count(*) AS n, max(count(*)) OVER () AS m FROM src GROUP BY y),
draws AS (SELECT y, draw, CAST(('0x' || substr(md5(CAST(y AS VARCHAR) || ':' || CAST(draw AS VARCHAR) || ':42'), 1, 15)) AS BIGINT) % n AS idx
          FROM (SELECT y, n, unnest(range(m)) AS draw FROM sizes) s)
SELECT s.id, s.y, s.domain, d.draw FROM draws d JOIN src s ON d.y = s.y AND d.idx = s.idx"""))
def smp_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir).select("id", "y", "domain")
    return S.oversample(rows, "y", "id", SEED)


@query("smp_quota_check", with_fixtures("scored", """
WITH requested AS (SELECT domain, y, CASE WHEN y = 1 THEN 4000 ELSE 1000000000 END AS requested FROM (SELECT DISTINCT domain, y FROM scored) c),
available AS (SELECT domain, y, count(*) AS available FROM scored GROUP BY domain, y)
SELECT r.domain, r.y, requested, available, least(available, requested) AS delivered, available < requested AS short
FROM requested r JOIN available a ON r.domain = a.domain AND r.y = a.y"""))
def smp_quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scored(spark, sf_dir).select("id", "domain", "y")
    buckets = S.bucket_counts(rows, ["domain", "y"], "id", SEED)
    sizes = S.class_sizes(buckets, ["domain", "y"])
    requested = sizes.select("domain", "y", F.when(F.col("y") == 1, 4000).otherwise(1_000_000_000).alias("requested"))
    quotas = requested.withColumnRenamed("requested", "quota")
    delivered = S.sample_by_quota(rows, ["domain", "y"], "id", quotas, SEED, buckets)
    return S.quota_check(rows, ["domain", "y"], delivered, requested, sizes)


@query("smp_shuffle", with_fixtures(
    "scored", "SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS position FROM scored"))
def smp_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffled(X.scored(spark, sf_dir).select("id"), "id", SEED)


@query("agg_class_distribution", with_fixtures("scored", f"""
WITH sizes AS (SELECT y, count(*) AS n FROM scored GROUP BY y)
SELECT 'before' AS stage, y, n AS rows FROM sizes UNION ALL SELECT 'after', y, (SELECT max(n) FROM sizes) FROM sizes"""))
def agg_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts before and after balancing."""
    rows = X.scored(spark, sf_dir).select("id", "y")
    before = B.class_distribution(rows, ["y"]).withColumn("stage", F.lit("before"))
    after = B.class_distribution(S.oversample(rows, "y", "id", SEED), ["y"]).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


_SUMMARY_SQL = f"""
SELECT split, target, source_platform, count(*) AS rows,
       CASE WHEN grouping(target) = 1 AND grouping(source_platform) = 1 THEN 'split' WHEN grouping(target) = 0 THEN 'target' ELSE 'platform' END AS section
FROM ({_SPLIT_ROWS}) r GROUP BY GROUPING SETS ((split), (split, target), (split, source_platform))"""


@query("agg_split_summary", _SUMMARY_SQL)
def agg_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_summary(split_rows(spark, sf_dir), "split", "target", "source_platform")


@query("agg_class_mapping", """
SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS class_index FROM (SELECT DISTINCT source FROM documents) d""")
def agg_class_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_mapping(table(spark, sf_dir, "documents"), "source")


# ---- arrays ----------------------------------------------------------------


def _embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir)


@query("arr_fix_length", with_fixtures("vectors", f"""
SELECT vec_id, {joined_items_sql('list_concat(v, list_transform(range(66), lambda i: 0e0))[1:130]')} AS padded,
       {joined_items_sql('v[1:40]')} AS cut FROM vectors"""))
def arr_fix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _embedding(spark, sf_dir).select(
        "vec_id", joined_items(A.fix_length(v, 130)).alias("padded"), joined_items(A.fix_length(v, 40)).alias("cut")
    )


_DB = "list_transform(v, lambda x: 1e1 * log10(greatest(x * x, 1e-10)))"


@query("arr_power_to_db", with_fixtures("vectors", f"""
SELECT vec_id, {joined_items_sql('list_transform(db, lambda x: greatest(x - top, -8e1))')} AS relative_db,
       {joined_items_sql('list_transform(db, lambda x: greatest(x, top - 8e1))')} AS fixed_db
FROM (SELECT vec_id, db, list_max(db) AS top FROM (SELECT vec_id, {_DB} AS db FROM vectors) d) t"""))
def arr_power_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = _embedding(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x * x).alias("power"))
    p = F.col("power")
    return power.select(
        "vec_id",
        joined_items(A.power_to_db(p)).alias("relative_db"),
        joined_items(A.power_to_db(p, relative=False)).alias("fixed_db"),
    )


@query("arr_global_standardize", with_fixtures("vectors", f"""
WITH e AS (SELECT unnest(v) AS x FROM vectors WHERE y = 1), s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM e)
SELECT vec_id, {joined_items_sql('list_transform(v, lambda x: (x - m) / (sd + 1e-6))')} AS v FROM vectors, s"""))
def arr_global_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embedding(spark, sf_dir)
    scaled = global_standardize(rows.filter("y = 1"), rows, "v")
    return scaled.select("vec_id", joined_items(F.col("v")).alias("v"))


@query("arr_sample_standardize", with_fixtures("vectors", f"""
SELECT vec_id, {joined_items_sql('list_transform(v, lambda x: (x - m) / (sd + 1e-8))')} AS v
FROM (SELECT vec_id, v, list_avg(v) AS m, list_stddev_samp(v) AS sd FROM vectors) s"""))
def arr_sample_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding(spark, sf_dir).select("vec_id", joined_items(A.sample_standardize(F.col("v"))).alias("v"))


# 64 values and two zeros that complete the last pixel
_PIXELS = "list_concat(list_transform(v, lambda x: floor((x + 1e0) * 1e2)), [0e0, 0e0])"


@query("arr_channel_normalize", with_fixtures("vectors", f"""
WITH px AS (SELECT vec_id, {_PIXELS} AS a FROM vectors)
SELECT vec_id,
  {joined_items_sql("list_transform(a, lambda x, i: (x / 2.55e2 - ([4.85e-1, 4.56e-1, 4.06e-1])[(i - 1) % 3 + 1]) / ([2.29e-1, 2.24e-1, 2.25e-1])[(i - 1) % 3 + 1])")} AS normalized,
  {joined_items_sql('list_transform(a, lambda x: x / 2.55e2)')} AS scaled,
  {joined_items_sql('list_transform(range(66), lambda j: a[j - j % 3 + 2 - j % 3 + 1])')} AS swapped FROM px"""))
def arr_channel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _embedding(spark, sf_dir).select(
        "vec_id",
        A.fix_length(F.transform("v", lambda x: F.floor((x + F.lit(1.0)) * F.lit(100.0)).cast("double")), 66).alias("a"),
    )
    a = F.col("a")
    return pixels.select(
        "vec_id",
        joined_items(A.channel_normalize(a)).alias("normalized"),
        joined_items(A.channel_normalize(a, "unit")).alias("scaled"),
        joined_items(A.channel_normalize(a, "raw_bgr")).alias("swapped"),
    )


@query("arr_to_mono", with_fixtures("vectors", f"""
SELECT vec_id, {joined_items_sql('list_transform(range(1, 33), lambda i: (v[i] + v[i + 32]) / 2)')} AS mono FROM vectors"""))
def arr_to_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    stereo = F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))
    return _embedding(spark, sf_dir).select("vec_id", joined_items(A.to_mono(stereo)).alias("mono"))


@query("arr_diagnostics", with_fixtures("vectors", f"""
SELECT vec_id, CAST(len(v) AS INT) AS length, {rounded('list_min(v)')} AS min_value, {rounded('list_max(v)')} AS max_value,
       {rounded('list_avg(v)')} AS mean_value, {rounded('list_stddev_pop(v)')} AS std_value FROM vectors"""))
def arr_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = A.diagnostics(_embedding(spark, sf_dir), "v").drop("v", "label", "y")
    return round_columns(report, "min_value", "max_value", "mean_value", "std_value")
