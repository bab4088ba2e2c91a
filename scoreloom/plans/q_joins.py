"""Queries: null-safe joins, outcome logs, pairs, set operations, ordering and release checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import checks as C
from scoreloom.operators import joins as J
from scoreloom.operators import logs as L
from scoreloom.operators import pairs as P
from scoreloom.operators import records as R
from scoreloom.operators import splits as S
from scoreloom.operators.coverage import clip_to_video
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query, r9
from scoreloom.plans.q_keys import RANK, VOCAB_SQL, md5_mod_sql, vocab
from scoreloom.plans.views import with_views

SAME = "{a}.key = {b}.key AND {a}.compression IS NOT DISTINCT FROM {b}.compression"


def same(a: str, b: str) -> str:
    return SAME.format(a=a, b=b)


LATEST_OUTCOME = """SELECT key, compression, max(seq) AS seq, arg_max(status, seq) AS status FROM fx_outcomes GROUP BY ALL"""
MAPPED = f"""SELECT label_key, CASE WHEN label_key = 'FAKE_B' THEN 'exclude' ELSE CAST("binary" AS VARCHAR) END AS mapped FROM ({VOCAB_SQL})"""


def store(spark: SparkSession, d: str) -> DataFrame:
    """The store log with one row per (key, seq): repeated positions would make `latest` ambiguous."""
    log = V.store_log(spark, d)
    return log.groupBy("key", "compression", "seq").agg(
        F.max("status").alias("status"), F.max("n_frames").alias("n_frames")
    )


STORE1 = """SELECT key, compression, seq, max(status) AS status, max(n_frames) AS n_frames FROM fx_store GROUP BY key, compression, seq"""
LATEST_STORE1 = """SELECT key, compression, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(n_frames, seq) AS n_frames FROM st GROUP BY ALL"""


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return R.label_table(vocab(spark, d), "binary", {"FAKE_B": "exclude"})


def split_videos(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    return R.records(v, S.carve_72_14_14(v))


INDEX = f"""SELECT v.dataset, v.key, v.compression, s.split, v.label_key, m.mapped, l.n_frames,
  CASE WHEN l.status IS NULL THEN 'not-processed' WHEN l.status <> 'ok' THEN 'processing-failed:' || l.status
       WHEN m.mapped = 'exclude' THEN 'label-excluded' WHEN l.n_frames = 0 THEN 'no-frames' END AS reason
FROM fx_videos v JOIN fx_splits s ON {same('s', 'v')} LEFT JOIN ls l ON {same('l', 'v')} LEFT JOIN m USING (label_key)"""


@query(
    "j02_index_with_reasons",
    with_views(
        "SELECT dataset, key, compression, split, mapped, n_frames, reason FROM i",
        "fx_splits", "fx_store", st=STORE1, ls=LATEST_STORE1, m=MAPPED, i=INDEX,
    ),
)
def j02(spark: SparkSession, d: str) -> DataFrame:
    index = J.index_videos(split_videos(spark, d), store(spark, d), mapping(spark, d))
    return index.select("dataset", "key", "compression", "split", "mapped", "n_frames", "reason")


@query(
    "a35_index_summary",
    with_views(
        "SELECT dataset, coalesce(reason, 'included') AS outcome, count(*) AS n FROM i GROUP BY ALL",
        "fx_splits", "fx_store", st=STORE1, ls=LATEST_STORE1, m=MAPPED, i=INDEX,
    ),
)
def a35(spark: SparkSession, d: str) -> DataFrame:
    index = J.index_videos(split_videos(spark, d), store(spark, d), mapping(spark, d))
    return J.index_summary(index, ["dataset"])


_VERIFY = f"""SELECT coalesce(a.key, b.key) AS key, coalesce(a.compression, b.compression) AS compression,
  CASE WHEN a.key IS NULL THEN 'extra' WHEN b.key IS NULL THEN 'missing'
       WHEN a.label_key <> b.label_key OR a.method <> b.method THEN 'label_mismatch' ELSE 'have' END AS bucket,
  a.key IS NOT NULL AND b.key IS NULL AND coalesce(s.split IN ('test', 'val'), false) AS requested
FROM fx_videos a FULL JOIN fx_videos2 b ON {same('a', 'b')} LEFT JOIN fx_splits s ON {same('s', 'a')}"""


def verified(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    return J.verify_inventory(v, V.videos_next(spark, d), S.carve_72_14_14(v), ["test", "val"])


@query("j03_verify_rows", with_views("SELECT * FROM x", "fx_videos2", "fx_splits", x=_VERIFY))
def j03(spark: SparkSession, d: str) -> DataFrame:
    return verified(spark, d)


@query(
    "j03_verify_counts",
    with_views(
        """SELECT *, CAST(CASE WHEN label_mismatch > 0 THEN 4 WHEN missing_requested > 0 THEN 3 ELSE 0 END AS INTEGER) AS exit_code FROM (
SELECT count(*) FILTER (bucket = 'have') AS have, count(*) FILTER (bucket = 'missing') AS missing,
  count(*) FILTER (requested) AS missing_requested, count(*) FILTER (bucket = 'extra') AS extra,
  count(*) FILTER (bucket = 'label_mismatch') AS label_mismatch FROM x)""",
        "fx_videos2", "fx_splits", x=_VERIFY,
    ),
)
def j03_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.bucket_counts(verified(spark, d))


@query(
    "j03_release_warnings",
    with_views(
        """SELECT task, missing, extra FROM (SELECT split_part(key, '/', 1) AS task, count(*) FILTER (bucket = 'missing') AS missing,
  count(*) FILTER (bucket = 'extra') AS extra FROM x GROUP BY 1) WHERE missing >= 10 AND extra >= 10""",
        "fx_videos2", "fx_splits", x=_VERIFY,
    ),
)
def j03_warnings(spark: SparkSession, d: str) -> DataFrame:
    return J.release_warnings(verified(spark, d))


@query(
    "k03_samples_per_bucket",
    with_views(
        """SELECT bucket, sample, CAST(place AS INTEGER) AS place FROM (SELECT bucket, sample, row_number() OVER (PARTITION BY bucket ORDER BY sample) AS place
FROM (SELECT bucket, key || '|' || coalesce(compression, '') AS sample FROM x)) WHERE place <= 20""",
        "fx_videos2", "fx_splits", x=_VERIFY,
    ),
)
def k03(spark: SparkSession, d: str) -> DataFrame:
    return L.first_per_bucket(verified(spark, d), "bucket", J.sample_text())


@query(
    "j04_protocol_scope",
    with_views(
        f"""SELECT s.split AS scope, count(*) AS n FROM fx_videos2 b JOIN fx_splits s ON {same('s', 'b')} GROUP BY s.split
UNION ALL SELECT 'not in inventory', count(*) FROM fx_splits s WHERE NOT EXISTS (SELECT 1 FROM fx_videos2 b WHERE {same('s', 'b')})""",
        "fx_videos2", "fx_splits",
    ),
)
def j04(spark: SparkSession, d: str) -> DataFrame:
    found, lacking = J.protocol_scope(split_videos(spark, d), V.videos_next(spark, d))
    counts = found.groupBy(F.col("split").alias("scope")).agg(F.count("*").alias("n"))
    return counts.unionByName(lacking.select(F.lit("not in inventory").alias("scope"), F.col("lacking").alias("n")))


@query(
    "w02_latest_outcome",
    with_views("SELECT * FROM lo", "fx_outcomes", lo=LATEST_OUTCOME),
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(V.outcomes(spark, d)).select("key", "compression", "seq", "status")


@query(
    "j05_work_list",
    with_views(
        f"""SELECT v.key, v.compression FROM fx_videos v LEFT JOIN ls l ON {same('l', 'v')} WHERE l.status IS NULL OR l.status IN ('no_face')""",
        "fx_store", st=STORE1, ls=LATEST_STORE1,
    ),
)
def j05(spark: SparkSession, d: str) -> DataFrame:
    todo = L.work_list(V.videos(spark, d), store(spark, d), ["no_face"])
    return todo.select(*R.KEY)


@query(
    "a34_store_status",
    with_views(
        f"""SELECT split_part(s.key, '/', 1) AS task, s.split, coalesce(l.status, 'not-processed') AS status, count(*) AS n
FROM fx_splits s LEFT JOIN ls l ON {same('l', 's')} GROUP BY ALL""",
        "fx_splits", "fx_store", st=STORE1, ls=LATEST_STORE1,
    ),
)
def a34(spark: SparkSession, d: str) -> DataFrame:
    return L.status_counts(split_videos(spark, d), L.latest(store(spark, d)), ["split"])


@query(
    "u01_fold_shards",
    with_views(
        """SELECT key, compression, arg_max(status, CASE WHEN status = 'ok' THEN 100 ELSE 0 END + step) AS status,
  arg_max(seq, CASE WHEN status = 'ok' THEN 100 ELSE 0 END + step) AS seq FROM r GROUP BY ALL""",
        "fx_outcomes",
        r="""SELECT key, compression, step, max(seq) AS seq, arg_max(status, seq) AS status
  FROM (SELECT *, CASE WHEN seq % 10 < 6 THEN -1 ELSE seq % 3 END AS step FROM fx_outcomes) GROUP BY key, compression, step""",
    ),
)
def u01(spark: SparkSession, d: str) -> DataFrame:
    log = V.outcomes(spark, d)
    seq = F.col("seq")
    index = log.where(seq % 10 < 6)
    shards = log.where(seq % 10 >= 6).withColumn("shard", (seq % 3).cast("int"))
    return L.fold_shards(index, shards).select("key", "compression", "status", "seq")


@query(
    "u05_upsert",
    with_views(
        f"""SELECT key, compression, label_key FROM fx_videos a WHERE NOT EXISTS (SELECT 1 FROM fx_videos2 b WHERE {same('a', 'b')})
UNION ALL SELECT key, compression, label_key FROM fx_videos2""",
        "fx_videos2",
    ),
)
def u05(spark: SparkSession, d: str) -> DataFrame:
    cols = [*R.KEY, "label_key"]
    return L.upsert(V.videos(spark, d).select(*cols), V.videos_next(spark, d).select(*cols), R.KEY)


@query(
    "u03_key_sets",
    with_views(
        """SELECT 'both' AS part, count(*) AS n FROM (SELECT dataset, key, compression FROM fx_ok INTERSECT SELECT dataset, key, compression FROM fx_scores WHERE status_b = 'ok')
UNION ALL SELECT 'only_a', count(*) FROM (SELECT dataset, key, compression FROM fx_ok EXCEPT SELECT dataset, key, compression FROM fx_scores WHERE status_b = 'ok')
UNION ALL SELECT 'only_b', count(*) FROM (SELECT dataset, key, compression FROM fx_scores WHERE status_b = 'ok' EXCEPT SELECT dataset, key, compression FROM fx_ok)""",
        "fx_ok",
    ),
)
def u03(spark: SparkSession, d: str) -> DataFrame:
    s = V.scores(spark, d)
    a = s.where(F.col("status") == "ok").select(*J.ROW_KEY)
    b = s.where(F.col("status_b") == "ok").select(*J.ROW_KEY)
    out = None
    for part, rows in (("both", a.intersect(b)), ("only_a", a.subtract(b)), ("only_b", b.subtract(a))):
        n = rows.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "j09_comparison_overlap",
    with_views(
        """SELECT dataset, count(*) FILTER (status = 'ok' AND status_b = 'ok') AS n, count(*) FILTER (status = 'ok' AND status_b <> 'ok') AS only_a,
  count(*) FILTER (status <> 'ok' AND status_b = 'ok') AS only_b, CAST(0 AS BIGINT) AS label_conflicts FROM fx_scores GROUP BY dataset""",
        "fx_scores",
    ),
)
def j09(spark: SparkSession, d: str) -> DataFrame:
    s = V.scores(spark, d)
    b = s.select(*J.ROW_KEY, "label", "score_b", F.col("status_b").alias("status"))
    return J.overlap_counts(J.shared_rows(s, b, "score", "score_b"), ["dataset"])


@query(
    "j11_relabelled",
    with_views(
        f"""SELECT b.dataset, b.key, b.compression FROM fx_videos a JOIN fx_videos2 b ON a.dataset = b.dataset AND {same('a', 'b')}
WHERE a.label_key <> b.label_key OR a.method <> b.method""",
        "fx_videos2",
    ),
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    return J.relabelled(V.videos(spark, d), V.videos_next(spark, d))


_SPLIT2 = """SELECT key, compression, CASE WHEN h < 14 AND n % 3 = 0 THEN 'test' WHEN h < 14 THEN 'val' WHEN h < 28 THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, {h} AS h FROM fx_videos2)"""


def _splits_next(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos_next(spark, d)
    carved = S.carve_72_14_14(v)
    moved = v.select(*R.KEY, "n")
    out = R.join_null_safe(carved, moved, R.KEY)
    split = F.when((F.col("split") == "val") & (F.col("n") % 3 == 0), "test").otherwise(F.col("split"))
    return out.select(*R.KEY, split.alias("split"))


@query(
    "j12_scheme_diff",
    with_views(
        f"""SELECT count(*) FILTER (a.key IS NULL) AS added, count(*) FILTER (b.key IS NULL) AS removed, count(*) FILTER (a.split <> b.split) AS moved
FROM fx_splits a FULL JOIN s2 b ON {same('a', 'b')}""",
        "fx_splits", "fx_videos2", s2=_SPLIT2.format(h=md5_mod_sql("identity", 100)),
    ),
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    return S.scheme_diff(S.carve_72_14_14(V.videos(spark, d)), _splits_next(spark, d))


@query(
    "j13_label_mapping_diff",
    with_views(
        """SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.mapping, b.mapping) AS mapping,
  count(*) FILTER (a.label_key IS NOT NULL AND b.label_key IS NOT NULL AND a.value <> b.value) AS changed_keys,
  count(*) FILTER (b.label_key IS NULL) AS dropped_keys, count(*) FILTER (a.label_key IS NULL) AS new_keys,
  CASE WHEN count(*) FILTER (b.label_key IS NULL OR a.value <> b.value) > 0 THEN 'changed' ELSE 'added' END AS change
FROM o a FULL JOIN w b USING (dataset, mapping, label_key) GROUP BY 1, 2
HAVING count(*) FILTER (a.label_key IS NULL OR b.label_key IS NULL OR a.value <> b.value) > 0""",
        "fx_videos2",
        o="""SELECT DISTINCT dataset, mapping, label_key, CASE mapping WHEN 'binary' THEN CASE WHEN label_key = 'REAL' THEN '0' ELSE '1' END ELSE method END AS value FROM fx_videos, (VALUES ('binary'), ('method')) AS m(mapping)""",
        w="""SELECT DISTINCT dataset, mapping, label_key, CASE mapping WHEN 'binary' THEN CASE WHEN label_key = 'REAL' THEN '0' ELSE '1' END ELSE 'm' || label_key END AS value FROM fx_videos2, (VALUES ('binary'), ('method')) AS m(mapping)""",
    ),
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    def table(v: DataFrame, method: object) -> DataFrame:
        rows = v.select("dataset", "label_key", method.alias("m")).distinct()
        binary = F.when(F.col("label_key") == "REAL", "0").otherwise("1")
        pairs = F.explode(F.create_map(F.lit("binary"), binary, F.lit("method"), F.col("m")))
        return rows.select("dataset", "label_key", pairs.alias("mapping", "value"))

    old = table(V.videos(spark, d), F.col("method"))
    new = table(V.videos_next(spark, d), F.concat(F.lit("m"), "label_key"))
    return J.label_diff(old, new)


@query(
    "a49_required_bump",
    with_views(
        f"""SELECT dataset, CASE WHEN relabelled > 0 OR removed > 0 THEN 'major' WHEN added > 0 THEN 'minor' ELSE 'none' END AS bump, relabelled, added, removed FROM (
SELECT coalesce(a.dataset, b.dataset) AS dataset, count(*) FILTER (a.label_key <> b.label_key OR a.method <> b.method) AS relabelled,
  count(*) FILTER (a.key IS NULL) AS added, count(*) FILTER (b.key IS NULL) AS removed
FROM fx_videos a FULL JOIN fx_videos2 b ON a.dataset = b.dataset AND {same('a', 'b')} GROUP BY 1)""",
        "fx_videos2",
    ),
)
def a49(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.plans.release import dataset_bumps

    return dataset_bumps(V.videos(spark, d), V.videos_next(spark, d))


def _listed(v: str, schemes: str) -> str:
    """All lists of a release as (dataset, kind, name, k, says)."""
    k = "key || '|' || coalesce(compression, '-')"
    return f"""SELECT dataset, 'videos' AS kind, '' AS name, {k} AS k, label_key || '|' || method AS says FROM {v}
UNION ALL SELECT dataset, 'scheme', s.name, {k}, CASE WHEN s.name = 'all' THEN 'test' WHEN n % s.m = 0 THEN 'test' ELSE 'train' END FROM {v}, (VALUES {schemes}) AS s(name, m) WHERE s.name <> 'half' OR dataset <> 'ds2'
UNION ALL SELECT DISTINCT dataset, 'labels', 'binary', label_key, CAST(label AS VARCHAR) FROM {v}"""


def _release(videos: DataFrame, schemes: dict[str, int]) -> dict[str, DataFrame]:
    each = F.explode(F.create_map(*[F.lit(x) for pair in schemes.items() for x in pair])).alias("scheme", "m")
    split = F.when((F.col("scheme") == "all") | (F.col("n") % F.col("m") == 0), "test").otherwise("train")
    scheme = videos.select("dataset", "key", "compression", "n", each).where("scheme <> 'half' OR dataset <> 'ds2'")
    labels = videos.select("dataset", F.lit("binary").alias("mapping"), "label_key", F.col("label").cast("string").alias("value"))
    return {"videos": videos, "scheme": scheme.withColumn("split", split), "labels": labels.distinct()}


@query(
    "a49_release_changes",
    with_views(
        """SELECT dataset, kind, name, change, CASE WHEN change = 'changed' THEN added END AS added, CASE WHEN change = 'changed' THEN removed END AS removed,
  CASE WHEN change = 'changed' THEN changed END AS changed,
  CASE WHEN change = 'new' OR (change = 'changed' AND kind = 'labels' AND removed = 0 AND changed = 0) THEN 'minor' ELSE 'major' END AS bump
FROM (SELECT *, CASE WHEN olds = 0 THEN 'new' WHEN news = 0 THEN 'removed' ELSE 'changed' END AS change FROM met) WHERE added + removed + changed > 0""",
        "fx_videos2",
        o=_listed("fx_videos", "('all', 1), ('half', 2), ('third', 3)"),
        w=_listed("fx_videos2", "('all', 1), ('half', 2), ('fifth', 5)"),
        met="""SELECT coalesce(o.dataset, w.dataset) AS dataset, coalesce(o.kind, w.kind) AS kind, coalesce(o.name, w.name) AS name, count(o.k) AS olds, count(w.k) AS news,
  count(*) FILTER (o.k IS NULL) AS added, count(*) FILTER (w.k IS NULL) AS removed, count(*) FILTER (o.says <> w.says) AS changed
FROM o FULL JOIN w ON o.dataset = w.dataset AND o.kind = w.kind AND o.name = w.name AND o.k = w.k GROUP BY ALL""",
    ),
)
def a49_release(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.plans.release import release_changes

    old = _release(V.videos(spark, d), {"all": 1, "half": 2, "third": 3})
    return release_changes(old, _release(V.videos_next(spark, d), {"all": 1, "half": 2, "fifth": 5}))


_REALS = """SELECT DISTINCT key AS real_key, substr(key, strpos(key, '/') + 1) AS lk, identity FROM fx_videos WHERE label = 0"""


def _pairs(spark: SparkSession, d: str, cap: int | None = 2) -> DataFrame:
    n = F.col("n")
    cand = F.array(F.col("identity"), F.when(n % 10 != 3, (n - 1).cast("string")), F.when(n % 5 == 1, ""))
    return P.resolve_pairs(
        V.videos(spark, d), is_real=F.col("label") == 0, candidates=F.array_compact(cand),
        fanout_cap=cap, rule="match", task_rank=RANK,
    )


_CAND = """SELECT DISTINCT key AS fake_key, c AS value FROM (SELECT key, unnest([identity, CASE WHEN n % 10 <> 3 THEN CAST(n - 1 AS VARCHAR) END, CASE WHEN n % 5 = 1 THEN '' END]) AS c FROM fx_videos WHERE label = 1) WHERE c <> ''"""


def _pair_sql(cap: str) -> dict[str, str]:
    return {
        "cand": _CAND,
        "reals": _REALS,
        "ranked": "SELECT *, row_number() OVER (PARTITION BY identity ORDER BY lk, real_key) AS rn FROM reals",
        "pr": f"""SELECT fake_key, real_key FROM cand JOIN reals ON lk = value
UNION SELECT fake_key, real_key FROM cand JOIN ranked ON identity = value WHERE rn <= {cap} AND value NOT IN (SELECT lk FROM reals)""",
    }


@query(
    "j06_fake_real_pairs",
    with_views("SELECT fake_key, real_key, 'match' AS rule FROM pr", "fx_videos", **_pair_sql("2")),
)
def j06(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(
    "j06_pairs_without_cap",
    with_views("SELECT fake_key, real_key, 'match' AS rule FROM pr", "fx_videos", **_pair_sql("1e9")),
)
def j06_all(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, None)


@query(
    "w03_first_reals_per_identity",
    with_views("SELECT identity, real_key FROM ranked WHERE rn <= 2", "fx_videos", **_pair_sql("2")),
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    reals = V.videos(spark, d).where("label = 0").select(
        F.col("identity").alias("_value"), F.col("key").alias("real_key")
    ).distinct()
    return P._first_reals(reals, 2, RANK).withColumnRenamed("_value", "identity")


@query(
    "u02_pairs_sorted",
    with_views(
        "SELECT real_key, fake_key, row_number() OVER (ORDER BY real_key, fake_key) AS place FROM pr",
        "fx_videos", **_pair_sql("2"),
    ),
)
def u02(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.operators.ordered import numbered

    pairs = _pairs(spark, d).unionByName(_pairs(spark, d)).distinct()
    out = numbered(pairs, [], ["real_key", "fake_key"], "place")
    return out.select("real_key", "fake_key", F.col("place").cast("long").alias("place"))


@query(
    "j07_pairs_of_split",
    with_views(
        """SELECT fake_key, real_key FROM pr LEFT JOIN sp a ON a.key = real_key LEFT JOIN sp b ON b.key = fake_key WHERE coalesce(a.split, b.split) = 'test'""",
        "fx_splits", **_pair_sql("2"),
        sp="SELECT key, split FROM fx_splits WHERE substr(key, strpos(key, '/') + 1)::BIGINT % 3 > 0",
    ),
)
def j07(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    sp = S.carve_72_14_14(v.where("n % 3 > 0"))
    return P.pairs_of_split(_pairs(spark, d).drop("rule"), sp, "test")


@query(
    "j08_paired_items",
    with_views(
        """SELECT real_key, fake_key, a.label_key AS real_label, b.label_key AS fake_label,
  row_number() OVER (ORDER BY real_key, fake_key) - 1 AS pair_id
FROM pr JOIN ix a ON a.key = real_key JOIN ix b ON b.key = fake_key""",
        "fx_videos", **_pair_sql("2"), ix="SELECT * FROM fx_videos WHERE n % 3 > 0",
    ),
)
def j08(spark: SparkSession, d: str) -> DataFrame:
    index = V.videos(spark, d).where("n % 3 > 0")
    kept, _ = P.paired_items(index, _pairs(spark, d))
    return kept.select(
        "real_key", "fake_key", F.col("real_item.label_key").alias("real_label"),
        F.col("fake_item.label_key").alias("fake_label"), "pair_id",
    )


@query(
    "j08_dropped_pairs",
    with_views(
        "SELECT count(*) AS dropped FROM pr WHERE real_key NOT IN (SELECT key FROM ix) OR fake_key NOT IN (SELECT key FROM ix)",
        "fx_videos", **_pair_sql("2"), ix="SELECT * FROM fx_videos WHERE n % 3 > 0",
    ),
)
def j08_dropped(spark: SparkSession, d: str) -> DataFrame:
    _, dropped = P.paired_items(V.videos(spark, d).where("n % 3 > 0"), _pairs(spark, d))
    return dropped.agg(F.count("*").alias("dropped"))


_SCORED = """SELECT dataset, key, compression, label, avg(score) AS score FROM fx_clips GROUP BY ALL"""


def all_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scored videos, failed ones and missing ones in one table."""
    v = V.videos(spark, d)
    scored = clip_to_video(V.clips(spark, d), [*J.ROW_KEY, "label"]).drop("n_clips")
    named = scored.join(v.select("key", "label_key", "method", "n"), "key")
    failed = F.col("n") % 13 == 1
    ok = named.where(~failed).withColumn("status", F.lit("ok"))
    error = named.where(failed).withColumns(
        {"status": F.lit("error"), "score": F.lit(None).cast("double")}
    )
    done = ok.unionByName(error).drop("n")
    return done.unionByName(J.missing_rows(v, done, R.label_table(vocab(spark, d), "binary")))


_ALL = """SELECT v.dataset, v.key, v.compression, v.label, CASE WHEN v.n % 13 <> 1 THEN s.score END AS score,
  CASE WHEN s.score IS NULL THEN 'missing' WHEN v.n % 13 = 1 THEN 'error' ELSE 'ok' END AS status
FROM fx_videos v LEFT JOIN sc s ON s.key = v.key"""


@query(
    "j18_missing_rows",
    with_views(
        """SELECT v.dataset, v.key, v.compression, v.label, v.label_key FROM fx_videos v WHERE key NOT IN (SELECT key FROM fx_clips) AND label_key <> 'FAKE_B'""",
        "fx_clips",
    ),
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    scored = V.clips(spark, d).select(*J.ROW_KEY).distinct()
    out = J.missing_rows(V.videos(spark, d), scored, mapping(spark, d))
    return out.select(*J.ROW_KEY, "label", "label_key")


@query(
    "u04_union_of_all_rows",
    with_views("SELECT dataset, key, compression, label, round(score, 9) AS score, status FROM a", "fx_clips", sc=_SCORED, a=_ALL),
)
def u04(spark: SparkSession, d: str) -> DataFrame:
    rows = all_rows(spark, d)
    return rows.select(*J.ROW_KEY, "label", r9("score").alias("score"), "status")


@query(
    "u06_weighted_sources",
    with_views(
        """SELECT c.source_id, CAST(c.n AS BIGINT) AS n, CAST(coalesce(sum(c.n) OVER (ORDER BY c.source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index,
  round(w / CAST(6.0 AS DOUBLE), 9) AS weight
FROM (SELECT CAST(substr(dataset, 3) AS INTEGER) AS source_id, count(*) AS n FROM fx_videos GROUP BY 1) c JOIN (VALUES (0, 1.0), (1, 2.0), (2, 3.0)) AS t(i, w) ON i = c.source_id""",
        "fx_videos",
    ),
)
def u06(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.operators.sampling import concat_sources, source_offsets

    v = V.videos(spark, d)
    parts = [v.where(F.col("dataset") == f"ds{i}") for i in range(3)]
    rows = concat_sources(parts)
    out = source_offsets(rows, [1.0, 2.0, 3.0])
    return out.select("source_id", "n", "first_index", r9("weight").alias("weight"))


@query(
    "k01_ordered_output",
    with_views(
        """SELECT dataset, key, compression, row_number() OVER (ORDER BY dataset, key, coalesce(compression, '')) AS place FROM fx_videos""",
        "fx_videos",
    ),
)
def k01(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.operators.ordered import numbered

    v = V.videos(spark, d).withColumn("_c", F.coalesce("compression", F.lit("")))
    out = numbered(v, [], ["dataset", "key", "_c"], "place")
    return out.select(*J.ROW_KEY, "place")


@query(
    "k02_limit_then_shard",
    with_views(
        f"""SELECT key, compression FROM (SELECT key, compression FROM fx_videos ORDER BY key, coalesce(compression, '') LIMIT 1000)
WHERE {md5_mod_sql("key || '|' || coalesce(compression, '')", 3)} = 1""",
        "fx_videos",
    ),
)
def k02(spark: SparkSession, d: str) -> DataFrame:
    return L.limited_shard(V.videos(spark, d).select(*R.KEY), limit=1000, shard=(1, 3))


@query(
    "j16_suite_entries_to_files",
    with_views(
        """SELECT e.protocol, e.split, min(f.file_index) AS file_index FROM
 (SELECT DISTINCT 'bench:' || o_orderstatus AS protocol, CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'val' END AS split FROM orders) e
 LEFT JOIN (SELECT o_orderkey AS file_index, 'bench:' || o_orderstatus AS protocol, 'test' AS split FROM orders WHERE o_orderkey > 10) f
 ON f.protocol = e.protocol AND f.split = e.split GROUP BY ALL"""
    ).replace("WITH \n", ""),
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    n = F.col("o_orderkey")
    protocol = F.concat(F.lit("bench:"), "o_orderstatus").alias("protocol")
    entries = o.select(protocol, F.when(n % 2 == 0, "test").otherwise("val").alias("split")).distinct()
    files = o.where(n > 10).select(n.alias("file_index"), protocol, F.lit("test").alias("split"))
    return J.first_match(entries, files, ("protocol", "split"))


@query(
    "j17_parity_checks",
    with_views(
        """SELECT dataset AS protocol, label_key AS split, round(avg(score), 9) AS measured, avg(score) IS NULL AS unmeasured,
  coalesce(abs(avg(score) - 0.7::DOUBLE) <= 0.05, false) AS passed FROM fx_scores GROUP BY ALL""",
        "fx_scores",
    ),
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    s = V.scores(spark, d)
    keys = [F.col("dataset").alias("protocol"), F.col("label_key").alias("split")]
    claims = s.select(*keys, F.lit("mean").alias("metric"), F.lit(0.7).alias("value")).distinct()
    measured = s.groupBy(*keys).agg(F.avg("score").alias("value")).withColumn("metric", F.lit("mean"))
    out = J.parity(claims, measured, 0.05)
    return out.select("protocol", "split", r9("measured").alias("measured"), "unmeasured", "passed")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    items = V.table(spark, d, "lineitem")
    return items.select(
        F.when(F.col("l_suppkey") % 4 == 0, "other").alias("folder"),
        F.col("l_linenumber").alias("copy_index"),
        F.concat(F.lit("v/"), "l_orderkey").alias("relpath"),
        F.concat(F.lit("root"), "l_linenumber", F.lit("/v/"), "l_orderkey").alias("path"),
    )


@query(
    "j19_first_copy_of_record",
    """SELECT o_orderkey, min(copy_index) AS copy_index, 'root' || min(copy_index) || '/v/' || o_orderkey AS resolved
FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'other' END AS folder FROM orders) o
LEFT JOIN (SELECT l_orderkey, l_linenumber AS copy_index, CASE WHEN l_suppkey % 4 = 0 THEN 'other' END AS f FROM lineitem) l
  ON l_orderkey = o_orderkey AND f IS NOT DISTINCT FROM folder GROUP BY o_orderkey""",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    records = V.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "other").alias("folder"),
        F.concat(F.lit("v/"), "o_orderkey").alias("relpath"),
    )
    out = J.first_copy(records, _listing(spark, d))
    return out.select("o_orderkey", "copy_index", "resolved")


@query(
    "w07_first_copy_of_task",
    """SELECT task, compression, min(c) AS chosen, coalesce(array_to_string(list_sort(list(DISTINCT c) FILTER (c > m)), ','), '') AS shadowed FROM (
SELECT l_returnflag AS task, CASE WHEN l_partkey % 50 < 40 THEN 'p' || l_partkey END AS compression, l_linenumber AS c,
  min(l_linenumber) OVER (PARTITION BY l_returnflag, CASE WHEN l_partkey % 50 < 40 THEN 'p' || l_partkey END) AS m FROM lineitem) GROUP BY ALL""",
)
def w07(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_partkey")
    listing = V.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("task"),
        F.when(p % 50 < 40, F.concat(F.lit("p"), p)).alias("compression"),
        F.col("l_linenumber").alias("copy_index"),
    )
    out = J.choose_copies(listing)
    return out.select("task", "compression", "chosen", F.array_join("shadowed", ",").alias("shadowed"))


@query(
    "j20_nearest_readable_frame",
    with_views(
        """SELECT key, clip_index, position, coalesce(
  (SELECT p2 FROM (SELECT DISTINCT position AS p2 FROM cf g WHERE g.key = c.key AND g.clip_index = c.clip_index AND g.good) ORDER BY abs(p2 - c.position), p2 LIMIT 1),
  (SELECT p2 FROM (SELECT position AS p2 FROM st s WHERE s.key = c.key AND s.good) ORDER BY abs(p2 - c.position), p2 LIMIT 1)) AS replacement,
  NOT good AS repaired FROM cf c""",
        st="""SELECT conv_id AS key, turn AS position, length(text) % 3 > 0 AS good FROM conversations""",
        cf="""SELECT key, position // 2 AS clip_index, position, good FROM st""",
    ),
)
def j20(spark: SparkSession, d: str) -> DataFrame:
    stored = V.table(spark, d, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("position"),
        (F.length("text") % 3 > 0).alias("good"),
    )
    clips = stored.select("key", F.floor(F.col("position") / 2).alias("clip_index"), "position")
    return J.repair_frames(clips, stored, ["key"])


@query(
    "d05_inventory_problems",
    with_views(
        """SELECT key, problem FROM (SELECT key, unnest([
  CASE WHEN NOT regexp_matches(key, '^[^/]+/.+$') THEN 'key is not task/id' END,
  CASE WHEN split_part(key, '/', 1) NOT IN ('REAL', 'FAKE_A', 'FAKE_B') THEN 'unknown task' END,
  CASE WHEN label_key <> split_part(key, '/', 1) THEN 'label key of another task' END]) AS problem FROM b) WHERE problem IS NOT NULL
UNION ALL SELECT key, 'listed more than once' FROM b GROUP BY key, compression HAVING count(*) > 1""",
        "fx_videos2",
        b="""SELECT CASE WHEN n % 41 = 0 THEN 'NEW/' || n WHEN n % 43 = 0 THEN 'REAL' ELSE key END AS key, compression, label_key FROM fx_videos2""",
    ),
)
def d05(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    key = F.when(n % 41 == 0, F.concat(F.lit("NEW/"), n)).when(n % 43 == 0, "REAL").otherwise(F.col("key"))
    rows = V.videos_next(spark, d).withColumn("key", key)
    tasks = vocab(spark, d).select(F.col("label_key").alias("task"), "label_key")
    return C.inventory_problems(rows, tasks)


@query(
    "d06_release_lint",
    with_views(
        f"""SELECT 'videos' AS place, 'listed more than once' AS message, count(*) AS n FROM (SELECT key, compression FROM vv GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'videos', 'unknown label key', count(*) FROM vv WHERE label_key NOT IN ('REAL', 'FAKE_A', 'FAKE_B')
UNION ALL SELECT 'videos', 'unlisted compression', count(*) FROM vv WHERE compression IS NOT NULL AND compression <> 'c23'
UNION ALL SELECT 'videos', 'local path', count(*) FROM vv WHERE method = '/data/x'
UNION ALL SELECT 'splits', 'not a listed video', count(*) FROM fx_splits s WHERE NOT EXISTS (SELECT 1 FROM vv v WHERE {same('s', 'v')})
UNION ALL SELECT 'pairs', 'not a listed video', (SELECT count(*) FROM pr WHERE real_key NOT IN (SELECT key FROM vv)) + (SELECT count(*) FROM pr WHERE fake_key NOT IN (SELECT key FROM vv))""",
        "fx_splits", "fx_videos2", **_pair_sql("2"),
        vv="SELECT dataset, key, compression, label_key, CASE WHEN method = 'other' THEN '/data/x' ELSE method END AS method FROM fx_videos2 UNION ALL SELECT dataset, key, compression, label_key, method FROM fx_videos2 WHERE n % 101 = 0 AND method <> 'other'",
    ),
)
def d06(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos_next(spark, d).drop("n", "label", "identity")
    v = v.withColumn("method", F.when(F.col("method") == "other", "/data/x").otherwise(F.col("method")))
    again = V.videos_next(spark, d).where("n % 101 = 0 AND method <> 'other'").select(*v.columns)
    issues = C.lint_release(
        v.unionByName(again), vocab(spark, d).select("label_key"), ["c23"],
        S.carve_72_14_14(V.videos(spark, d)), _pairs(spark, d),
    )
    return issues.groupBy("place", "message").agg(F.count("*").alias("n"))
