"""Queries: key expressions, filters, labels, split rules, draws and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import keys as K
from scoreloom.operators import fingerprint as FP
from scoreloom.operators import records as R
from scoreloom.operators import splits as S
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query, r9
from scoreloom.plans.views import with_views


def md5_mod_sql(text: str, n: int) -> str:
    """DuckDB's md5 modulo n, 32 bits at a time."""
    shift = (1 << 32) % n
    acc = "0::UBIGINT"
    for i in range(4):
        acc = f"({acc} * {shift} + ('0x' || substr(md5({text}), {1 + 8 * i}, 8))::UBIGINT) % {n}"
    return f"CAST({acc} AS INTEGER)"


def sha64_sql(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 16))::UBIGINT"


_ATTRS = """SELECT *, MAP {'lang': CASE WHEN n % 3 = 0 THEN 'en' WHEN n % 3 = 1 THEN 'fr' END, 'shard': CAST(n % 11 AS VARCHAR)} AS attrs FROM fx_videos"""


def videos_with_attrs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    lang = F.when(n % 3 == 0, "en").when(n % 3 == 1, "fr")
    return V.videos(spark, d).withColumn(
        "attrs",
        F.create_map(F.lit("lang"), lang, F.lit("shard"), (n % 11).cast("string")),
    )


@query(
    "p01_where_filter",
    with_views(
        """SELECT v.dataset, v.key, v.compression, s.split FROM a v JOIN fx_splits s
  ON s.key = v.key AND s.compression IS NOT DISTINCT FROM v.compression
WHERE (v.compression = 'c23' OR v.compression IS NULL) AND v.label_key <> 'FAKE_B'
  AND map_extract(attrs, 'lang')[1] = 'en' AND s.split IN ('val', 'test')""",
        "fx_splits",
        a=_ATTRS,
    ),
)
def p01(spark: SparkSession, d: str) -> DataFrame:
    v = videos_with_attrs(spark, d)
    where = {"compression": ["c23", None], "task": {"REAL", "FAKE_A"}, "attrs.lang": "en"}
    out = R.records(v, S.carve_72_14_14(V.videos(spark, d)), split=["val", "test"], where=where)
    return out.select("dataset", "key", "compression", "split")


@query(
    "p02_unknown_where_fields",
    with_views(
        """SELECT w.wanted, (SELECT name FROM names ORDER BY levenshtein(w.wanted, name), name LIMIT 1) AS nearest
FROM (VALUES ('lang'), ('langs'), ('shrad')) AS w(wanted) WHERE w.wanted NOT IN (SELECT name FROM names)""",
        "fx_videos",
        a=_ATTRS,
        names="SELECT DISTINCT unnest(map_keys(attrs)) AS name FROM a",
    ),
)
def p02(spark: SparkSession, d: str) -> DataFrame:
    where = {"attrs.lang": "en", "attrs.langs": "en", "attrs.shrad": "1", "key": "x"}
    return R.check_where(videos_with_attrs(spark, d), where)


@query(
    "p03_canonical_where",
    with_views(
        """SELECT '[{"key":"identity","value":["' || a || '","' || b || '"]},{"key":"task","value":["FAKE_A","REAL"]}]' AS where_key, count(*) AS n
FROM (SELECT least('p' || o_custkey % 7, 'p' || o_custkey % 5) AS a, greatest('p' || o_custkey % 7, 'p' || o_custkey % 5) AS b FROM orders) GROUP BY ALL"""
    ).replace("WITH \n", ""),
)
def p03(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    ids = F.array(F.concat(F.lit("p"), c % 7), F.concat(F.lit("p"), c % 5))
    tasks = F.when(c % 2 == 0, F.array(F.lit("REAL"), F.lit("FAKE_A"))).otherwise(
        F.array(F.lit("FAKE_A"), F.lit("REAL"))
    )
    where = F.when(c % 3 == 0, F.create_map(F.lit("task"), tasks, F.lit("identity"), ids)).otherwise(
        F.create_map(F.lit("identity"), ids, F.lit("task"), tasks)
    )
    rows = V.table(spark, d, "orders").select(R.canonical_where(where).alias("where_key"))
    return rows.groupBy("where_key").agg(F.count("*").alias("n"))


@query(
    "p04_key_parts",
    """SELECT page_id, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '' END AS task,
  split_part(p, '/', 1) AS task_or_key,
  CASE WHEN contains(p, '/') THEN substr(p, strpos(p, '/') + 1) ELSE p END AS local,
  trim(regexp_replace(p, '[^A-Za-z0-9]+', '_', 'g'), '_') AS tidy,
  regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem
FROM (SELECT page_id, substr(url, 8 + page_id % 40) AS p FROM pages)""",
)
def p04(spark: SparkSession, d: str) -> DataFrame:
    p = F.substr("url", F.lit(8) + (F.col("page_id") % 40).cast("int"))
    rows = V.table(spark, d, "pages").select("page_id", p.alias("p"))
    p = F.col("p")
    return rows.select(
        "page_id",
        K.task_of(p).alias("task"),
        K.task_or_key(p).alias("task_or_key"),
        K.local_key(p).alias("local"),
        K.sanitised(p).alias("tidy"),
        K.stem_of(p).alias("stem"),
    )


@query(
    "p05_carve_key",
    with_views(
        "SELECT key, compression, CASE WHEN n % 4 = 0 THEN substr(key, strpos(key, '/') + 1) ELSE identity END AS carve FROM fx_videos",
        "fx_videos",
    ),
)
def p05(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    identity = F.when(n % 8 == 0, "").when(n % 8 == 4, F.lit(None)).otherwise(F.col("identity"))
    return V.videos(spark, d).select(
        "key", "compression", K.carve_key(F.col("key"), identity).alias("carve")
    )


@query(
    "p06_carve_hash",
    f"""SELECT page_id, {md5_mod_sql('url', 100)} AS h100, {md5_mod_sql('url', 7)} AS h7 FROM pages""",
)
def p06(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return V.table(spark, d, "pages").select(
        "page_id", K.md5_mod(u, 100).alias("h100"), K.md5_mod(u, 7).alias("h7")
    )


@query(
    "p07_shard_rows",
    with_views(
        f"""SELECT {md5_mod_sql("key || '|' || coalesce(compression, '')", 5)} AS shard, count(*) AS n FROM fx_videos GROUP BY ALL""",
        "fx_videos",
    ),
)
def p07(spark: SparkSession, d: str) -> DataFrame:
    shard = K.shard_of(F.col("key"), F.col("compression"), 5)
    return V.videos(spark, d).groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


@query(
    "p08_hash_uniform_scores",
    with_views(
        f"""SELECT key, compression, round(CAST({sha64_sql("'3|' || dataset || '|' || key || '|' || coalesce(compression, '')")} AS DOUBLE) / 18446744073709551616.0::DOUBLE, 9) AS score FROM fx_videos""",
        "fx_videos",
    ),
)
def p08(spark: SparkSession, d: str) -> DataFrame:
    score = K.hash_uniform(3, F.col("dataset"), F.col("key"), F.col("compression"))
    return V.videos(spark, d).select("key", "compression", r9(score).alias("score"))


@query(
    "p09_draw_seeds",
    f"""SELECT event_id, CAST({sha64_sql("event_id || ':4'")} AS VARCHAR) AS epoch_seed,
  CAST({sha64_sql("'9:2:' || event_id")} AS VARCHAR) AS item_seed FROM events""",
)
def p09(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return V.table(spark, d, "events").select(
        e,
        K.draw_seed(e, 4).cast("string").alias("epoch_seed"),
        K.draw_seed(9, 2, e).cast("string").alias("item_seed"),
    )


def vocab(spark: SparkSession, d: str) -> DataFrame:
    """The label vocabulary the videos use, one row per label key."""
    keys = V.videos(spark, d).select("label_key").distinct()
    k = F.col("label_key")
    return keys.select(
        "label_key",
        F.when(k == "REAL", 0).otherwise(1).alias("binary"),
        F.when(k == "REAL", "real").when(k == "FAKE_A", "face-swap").otherwise("lip-sync").alias(
            "family"
        ),
    )


VOCAB_SQL = """SELECT label_key, CASE WHEN label_key = 'REAL' THEN 0 ELSE 1 END AS "binary",
  CASE label_key WHEN 'REAL' THEN 'real' WHEN 'FAKE_A' THEN 'face-swap' ELSE 'lip-sync' END AS family
  FROM (SELECT DISTINCT label_key FROM fx_videos)"""


@query(
    "p10_label_mapping",
    with_views(
        """SELECT dataset, mapped, count(*) AS n FROM (SELECT dataset, CASE WHEN label_key = 'FAKE_B' THEN 'exclude' ELSE CAST("binary" AS VARCHAR) END AS mapped
  FROM fx_videos JOIN v USING (label_key)) GROUP BY ALL""",
        "fx_videos",
        v=VOCAB_SQL,
    ),
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    mapping = R.label_table(vocab(spark, d), "binary", {"FAKE_B": "exclude"})
    out = R.with_labels(V.videos(spark, d), mapping)
    return out.groupBy("dataset", "mapped").agg(F.count("*").alias("n"))


@query(
    "p11_real_rows",
    with_views("SELECT key, compression FROM fx_videos WHERE label = 0", "fx_videos"),
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    mapping = R.label_table(vocab(spark, d), "binary")
    return R.with_labels(V.videos(spark, d), mapping).where(F.col("mapped") == "0").select(*R.KEY)


@query(
    "p12_portable_rows",
    with_views("SELECT key, compression, 'lang' AS attr_names FROM fx_videos", "fx_videos"),
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    rows = videos_with_attrs(spark, d).withColumn("relpath", K.video_relpath(F.col("key"), F.col("compression")))
    out = R.portable(rows, ["shard"])
    assert "relpath" not in out.columns
    return out.select(*R.KEY, F.array_join(F.map_keys("attrs"), ",").alias("attr_names"))


@query(
    "p13_release_rows",
    with_views(
        "SELECT key, compression FROM fx_videos WHERE compression IS NULL OR compression = 'c40'",
        "fx_videos",
    ),
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    return R.release_rows(V.videos(spark, d), ["c40"]).select(*R.KEY)


@query(
    "p26_compression_folders",
    """SELECT o_orderkey, c.compression, CASE WHEN o_orderkey % 2 = 0 THEN 'videos/' || c.compression || '/' || o_custkey ELSE 'videos/' || o_custkey END AS folder
FROM orders JOIN (VALUES (0, 'raw'), (0, 'c40'), (1, NULL)) AS c(m, compression) ON c.m = o_orderkey % 2""",
)
def p26(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    pattern = F.when(n % 2 == 0, F.concat(F.lit("videos/{cX}/"), "o_custkey")).otherwise(
        F.concat(F.lit("videos/"), "o_custkey")
    )
    each = F.explode(K.expand_compressions(pattern, ["raw", "c23", "c40"], ["c40", "raw"]))
    return V.table(spark, d, "orders").select("o_orderkey", each.alias("e")).select("o_orderkey", "e.*")


@query(
    "p27_paths_and_slugs",
    with_views(
        """SELECT key, compression, key || '/' || coalesce(compression, '_') AS relpath,
  coalesce(nullif(trim(regexp_replace(lower(trim(key || ' ' || identity || '!')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug FROM fx_videos""",
        "fx_videos",
    ),
)
def p27(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("key"), F.lit(" "), F.col("identity"), F.lit("!"))
    return V.videos(spark, d).select(
        *R.KEY, K.video_relpath(F.col("key"), F.col("compression")).alias("relpath"), K.slug(text).alias("slug")
    )


@query(
    "p28_portable_text",
    """SELECT doc_id, 'cannot read ' || lang || doc_id || '.mp4, see ' || source || ': ' || md5(text) AS reason, 'a / b' AS kept FROM documents""",
)
def p28(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("cannot read /data/"), "source", F.lit("/"), "lang", "doc_id", F.lit(".mp4, see ~/logs/"),
        "source", F.lit(": "), F.md5("text"),
    )
    # a comma ends no path, so the file name keeps the one that follows it
    return V.table(spark, d, "documents").select(
        "doc_id", K.portable_text(raw).alias("reason"), K.portable_text(F.lit("a / b")).alias("kept")
    )


@query(
    "d01_path_leaks",
    r"""SELECT 'documents' AS place, count(*) AS n FROM documents
WHERE regexp_matches(text, '(?:^|[\s=:,;"''(])(?:~/|/(?:[^/\s]|$))|file:///')
  OR regexp_matches(regexp_replace(text, 'https?://[^\s"''<>()\[\]]+', ' ', 'g'), '/home/|/mnt/|/media/|/Users/|/scratch/|/data/|C:\\|~/')
UNION ALL
SELECT 'pages', count(*) FROM pages
WHERE regexp_matches(html, '(?:^|[\s=:,;"''(])(?:~/|/(?:[^/\s]|$))|file:///')
  OR regexp_matches(regexp_replace(html, 'https?://[^\s"''<>()\[\]]+', ' ', 'g'), '/home/|/mnt/|/media/|/Users/|/scratch/|/data/|C:\\|~/')""",
)
def d01(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, column in (("documents", "text"), ("pages", "html")):
        rows = V.table(spark, d, name)
        part = rows.agg(F.count_if(K.leaks_local_path(F.col(column))).alias("n")).select(
            F.lit(name).alias("place"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


_OFFICIAL = """SELECT key, CASE WHEN n % 7 < 3 THEN 'train' WHEN n % 7 < 5 THEN 'test' ELSE 'exclude' END AS split FROM fx_videos WHERE n % 7 < 6"""


def official_list(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    split = F.when(n % 7 < 3, "train").when(n % 7 < 5, "test").otherwise("exclude")
    return V.videos(spark, d).where(n % 7 < 6).select("key", split.alias("split"))


_H = md5_mod_sql("identity", 100)
_8020 = f"CASE WHEN {_H} < 20 THEN 'val' ELSE 'train' END"
_RULES = {
    "r01_all_test": ("all-test", {}, "SELECT key, compression, 'test' AS split FROM fx_videos"),
    "r02_carve_72_14_14": ("ident-72-14-14", {}, "SELECT key, compression, split FROM fx_splits"),
    "r03_carve_80_20": ("ident-80-20", {}, f"SELECT key, compression, {_8020} AS split FROM fx_videos"),
    "r04_official": ("official", {}, "SELECT v.key, v.compression, o.split FROM fx_videos v JOIN o ON o.key = v.key"),
    "r05_official_plus_carve_rest": (
        "official+ident-80-20", {"policy": "test-only-official"},
        f"SELECT v.key, v.compression, CASE WHEN o.split IN ('test', 'exclude') THEN o.split ELSE {_8020} END AS split FROM fx_videos v LEFT JOIN o ON o.key = v.key",
    ),
    "r05_official_plus_carve_train": (
        "official+ident-80-20", {"policy": "official-train-test"},
        f"SELECT v.key, v.compression, CASE WHEN o.split IN ('test', 'exclude') THEN o.split ELSE {_8020} END AS split FROM fx_videos v JOIN o ON o.key = v.key",
    ),
}


def _rule(name: str, rule: str, params: dict, sql: str) -> None:
    @query(name, with_views(sql, "fx_splits", o=_OFFICIAL))
    def plan(spark: SparkSession, d: str) -> DataFrame:
        return S.assign(rule, params, V.videos(spark, d), listed=official_list(spark, d))


for _n, (_r, _p, _s) in _RULES.items():
    _rule(_n, _r, _p, _s)

RANK = {"REAL": 0, "FAKE_A": 1, "FAKE_B": 2}


def _draw(pool: str, seed: int, k: int, strata: str, cap: str) -> str:
    """The rows with the smallest hashes: `k` fakes per stratum, and as many reals, `cap` at most."""
    by = f"PARTITION BY {strata} " if strata else ""
    return with_views(
        f"""SELECT key, compression, 'test' AS split FROM fakes WHERE rn <= {k} UNION ALL SELECT key, compression, 'test' FROM reals
WHERE rn <= least((SELECT count(*) FROM fakes WHERE rn <= {k}), {cap})""",
        "fx_videos",
        o=_OFFICIAL,
        pool=f"SELECT *, md5('{seed}:' || key || ':' || coalesce(compression, '')) AS h FROM fx_videos WHERE {pool}",
        fakes=f"SELECT *, row_number() OVER ({by}ORDER BY h) AS rn FROM pool WHERE label = 1",
        reals="SELECT *, row_number() OVER (ORDER BY h) AS rn FROM pool WHERE label = 0",
    )


@query(
    "k04_benchmark_draw",
    _draw("compression IN ('c23', 'c40') AND key IN (SELECT key FROM o WHERE split = 'test')", 7, 4, "label_key", "6"),
)
def k04(spark: SparkSession, d: str) -> DataFrame:
    params = {"k_fake": 4, "strata": ("task",), "seed": 7, "compressions": ("c23", "c40"), "k_real_cap": 6}
    return S.assign(
        "benchmark", params, V.videos(spark, d), listed=official_list(spark, d),
        is_real=F.col("label") == 0, task_rank=RANK,
    )


@query("r06_benchmark_by_identity", _draw("label_key <> 'FAKE_B'", 1, 3, "identity", "1000000000"))
def r06(spark: SparkSession, d: str) -> DataFrame:
    spec = S.BenchmarkSpec(k_fake=3, strata=("identity",), seed=1, exclude_tasks=("FAKE_B",))
    return S.benchmark(V.videos(spark, d), spec, is_real=F.col("label") == 0, task_rank=RANK)


@query(
    "r07_rule_by_name",
    with_views(
        f"""SELECT 'all-test' AS rule, 'test' AS split, count(*) AS n FROM fx_videos
UNION ALL SELECT 'ident-72-14-14', split, count(*) FROM fx_splits GROUP BY split
UNION ALL SELECT 'ident-80-20', {_8020}, count(*) FROM fx_videos GROUP BY 2
UNION ALL SELECT 'official', o.split, count(*) FROM fx_videos v JOIN o ON o.key = v.key GROUP BY 2""",
        "fx_splits",
        o=_OFFICIAL,
    ),
)
def r07(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for rule in ("all-test", "ident-72-14-14", "ident-80-20", "official"):
        rows = S.assign(rule, {}, V.videos(spark, d), listed=official_list(spark, d))
        part = S.split_counts(rows).select(F.lit(rule).alias("rule"), "split", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("r08_scheme_from_official_pool", _draw("key IN (SELECT key FROM o WHERE split = 'test')", 3, 50, "", "1000000000"))
def r08(spark: SparkSession, d: str) -> DataFrame:
    rows = S.assign(
        "benchmark", {"k_fake": 50, "seed": 3}, V.videos(spark, d), listed=official_list(spark, d),
        is_real=F.col("label") == 0, task_rank=RANK,
    )
    return rows.orderBy(*R.KEY)


@query(
    "a31_scheme_counts",
    with_views(
        "SELECT dataset, split, count(*) AS n FROM fx_splits GROUP BY ALL", "fx_splits"
    ),
)
def a31(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    rows = R.records(v, S.carve_72_14_14(v))
    return S.split_counts(rows, ["dataset"])


@query(
    "a33_protocol_counts",
    with_views(
        """SELECT s.split, v.compression, v.label_key, count(*) AS n FROM fx_videos v JOIN fx_splits s
  ON s.key = v.key AND s.compression IS NOT DISTINCT FROM v.compression GROUP BY ALL""",
        "fx_splits",
    ),
)
def a33(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    return S.split_counts(R.records(v, S.carve_72_14_14(v)), ["compression", "label_key"])


def fingerprint_sql(lines: str, by: str = "") -> str:
    words = ", ".join(
        f"CAST(sum(CAST(('0x' || substr(d, {1 + 8 * i}, 8))::UBIGINT AS HUGEINT)) AS VARCHAR)" for i in range(8)
    )
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {cols}count(*) AS n, sha256(concat_ws(':', count(*), {words})) AS fingerprint"
        f" FROM (SELECT {cols}sha256(line) AS d FROM ({lines})){group}"
    )


_SPLIT_LINES = "SELECT dataset, key || chr(9) || coalesce(compression, '') || chr(9) || split AS line FROM fx_splits"


@query(
    "a30_fingerprint",
    with_views(fingerprint_sql("SELECT * FROM l", "dataset"), "fx_splits", l=_SPLIT_LINES),
)
def a30(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    rows = R.records(v, S.carve_72_14_14(v))
    return FP.fingerprint(rows, FP.split_line(), ["dataset"])


@query(
    "j01_records_of_split",
    with_views(
        """SELECT v.dataset, v.key, v.compression, v.label_key FROM fx_videos v JOIN fx_splits s
  ON s.key = v.key AND s.compression IS NOT DISTINCT FROM v.compression WHERE s.split = 'test'""",
        "fx_splits",
    ),
)
def j01(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    out = R.records(v, S.carve_72_14_14(v), split="test")
    return out.select("dataset", "key", "compression", "label_key")
