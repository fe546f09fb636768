"""Queries on labels: name joins, footprints, dates, cards, survey columns, residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.functions import scalars as X
from rosterlens.functions.draws import keyed_hash
from rosterlens.operators import labels as L
from rosterlens.operators.gates import contains_any
from rosterlens.plans.common_sql import MODELS, h
from rosterlens.plans.common_sql import sql_literal as q
from rosterlens.plans.q_cells import rounded
from rosterlens.plans.registry import query
from rosterlens.sources import tables as T


def boards(spark, sf):
    """boards(board, name, pos, value): suppliers published under four spellings on three boards.

    A fifth of the suppliers is unlisted, and every tenth also appears under a second
    organisation, which folds to the same key.
    """
    v = F.round(F.avg("l_extendedprice"), 2)
    per = (
        T.table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.concat(F.lit("flag_"), F.col("l_returnflag")).alias("board"))
        .agg(v.alias("value"))
        .join(T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    )
    k, n = F.col("l_suppkey"), F.col("s_name")
    spell = keyed_hash("0", "publish", k) % 5
    first = (
        F.when(spell == 0, n)
        .when(spell == 1, F.concat(F.lit("acme/"), F.upper(n)))
        .when(spell == 2, F.concat(F.lit("org__"), F.replace(n, F.lit("#"), F.lit("-"))))
        .when(spell == 3, F.concat(F.lit("Vendor "), k.cast("string")))
    )
    second = F.when(k % 10 == 0, F.concat(F.lit("other/"), F.replace(n, F.lit("#"), F.lit(" "))))
    names = F.filter(F.array(F.struct(first.alias("name"), (k * 2).alias("pos")), F.struct(second.alias("name"), (k * 2 + 1).alias("pos"))), lambda s: s["name"].isNotNull())
    return per.select("board", "value", F.explode(names).alias("s")).select("board", "s.name", "s.pos", "value")


def aliases(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").filter(k % 2 == 0).select(
        F.concat(F.lit("vendor_"), k.cast("string")).alias("published"), F.col("s_name").alias("model"), k.alias("pos")
    )


BOARDS = f"""per AS (SELECT l_suppkey AS k, 'flag_' || l_returnflag AS board, round(avg(l_extendedprice), 2) AS value, any_value(s_name) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  bo AS (SELECT *, {h("'0'", "'publish'", 'k')} % 5 AS spell FROM per),
  boards AS (SELECT board, CASE spell WHEN 0 THEN n WHEN 1 THEN 'acme/' || upper(n) WHEN 2 THEN 'org__' || replace(n, '#', '-') ELSE 'Vendor ' || k END AS name, k * 2 AS pos, value FROM bo WHERE spell <> 4
    UNION ALL SELECT board, 'other/' || replace(n, '#', ' '), k * 2 + 1, value FROM bo WHERE k % 10 = 0),
  aliases AS (SELECT 'vendor_' || s_suppkey AS published, s_name AS model, s_suppkey AS pos FROM supplier WHERE s_suppkey % 2 = 0)"""


def mk(n: str) -> str:
    return f"regexp_replace(lower(list_extract(string_split(replace({n}, '/', '__'), '__'), -1)), '[^a-z0-9]', '', 'g')"


MATCH = f"""pk AS (SELECT {mk('name')} AS key, arg_min(name, pos) AS source, count(DISTINCT name) AS n_names FROM pub GROUP BY 1),
  via AS (SELECT {mk('model')} AS key, arg_max(source, pos) AS alias_source FROM aliases JOIN pk ON pk.key = {mk('published')} GROUP BY 1),
  match AS (SELECT model_id, name, coalesce(source, alias_source) AS source, (source IS NULL AND alias_source IS NOT NULL)::INT AS via_alias
    FROM models LEFT JOIN pk ON pk.key = {mk('name')} LEFT JOIN via ON via.key = {mk('name')})"""

PUB = "pub AS (SELECT name, pos FROM boards WHERE board = 'flag_A')"


def published(spark, sf):
    return boards(spark, sf).filter("board = 'flag_A'").select("name", "pos")


@query("match_key", f"WITH {BOARDS} SELECT DISTINCT name, {mk('name')} AS key FROM boards")
def match_key(spark, sf):
    return boards(spark, sf).select("name", X.match_key(F.col("name")).alias("key")).distinct()


@query("match_models", f"WITH {MODELS}, {BOARDS}, {PUB}, {MATCH} SELECT model_id, name, source, via_alias FROM match")
def match_models(spark, sf):
    return L.match_models(T.models(spark, sf), published(spark, sf), aliases(spark, sf))


@query(
    "match_counts",
    f"""WITH {MODELS}, {BOARDS}, {PUB}, {MATCH} SELECT count(*) FILTER (source IS NOT NULL AND via_alias = 0) AS n_exact, count(*) FILTER (source IS NOT NULL AND via_alias = 1) AS n_alias,
    count(source) AS n_matched, count(*) - count(source) AS n_unmatched_models, (SELECT count(*) FROM pk) AS n_published FROM match""",
)
def match_counts(spark, sf):
    pub = published(spark, sf)
    return L.match_counts(L.match_models(T.models(spark, sf), pub, aliases(spark, sf)), pub)


@query(
    "unmatched_published",
    f"""WITH {MODELS}, {BOARDS}, {PUB}, {MATCH}, own AS (SELECT {mk('name')} AS key FROM models),
    claimed AS (SELECT key FROM own UNION SELECT {mk('published')} FROM aliases WHERE {mk('model')} IN (SELECT key FROM own ANTI JOIN pk USING (key)))
    SELECT source FROM pk ANTI JOIN claimed USING (key)""",
)
def unmatched_published(spark, sf):
    pub = published(spark, sf)
    al = aliases(spark, sf)
    return L.unmatched_published(L.match_models(T.models(spark, sf), pub, al), pub, al)


@query(
    "ambiguous_refused",
    f"""WITH {BOARDS}, {PUB} SELECT name, pos FROM (SELECT *, {mk('name')} AS key FROM pub) QUALIFY count(*) OVER (PARTITION BY key) = 1""",
)
def ambiguous_refused(spark, sf):
    return L.unambiguous(published(spark, sf))


def s_label(board: str, p: str) -> str:
    return f"""{p}_u AS (SELECT name, pos, value, {mk('name')} AS key FROM boards WHERE board = '{board}' QUALIFY count(*) OVER (PARTITION BY key) = 1),
   {p}_via AS (SELECT {mk('model')} AS key, arg_max(u.value, a.pos) AS value FROM aliases a JOIN {p}_u u ON u.key = {mk('published')} GROUP BY 1),
   {p} AS (SELECT model_id, CASE WHEN u.key IS NOT NULL THEN u.value ELSE v.value END AS value FROM models LEFT JOIN {p}_u u ON u.key = {mk('models.name')} LEFT JOIN {p}_via v ON v.key = {mk('models.name')})"""


def label(spark, sf, board):
    b = boards(spark, sf).filter(F.col("board") == board).drop("board")
    return L.label_column(T.models(spark, sf), b, aliases(spark, sf))


@query("label_column", f"WITH {MODELS}, {BOARDS}, {s_label('flag_A', 'la')} SELECT model_id, round(value, 6) AS value FROM la")
def label_column(spark, sf):
    return rounded(label(spark, sf, "flag_A"), "value")


@query(
    "contrast_column",
    f"""WITH {MODELS}, {BOARDS}, {s_label('flag_A', 'la')}, {s_label('flag_R', 'lr')} SELECT model_id, round(la.value - lr.value, 6) AS value FROM la JOIN lr USING (model_id)""",
)
def contrast_column(spark, sf):
    b = boards(spark, sf)
    out = L.contrast_column(
        T.models(spark, sf),
        b.filter("board = 'flag_A'").drop("board"),
        b.filter("board = 'flag_R'").drop("board"),
        aliases(spark, sf),
    )
    return rounded(out, "value")


@query(
    "label_coverage",
    f"""WITH {MODELS}, {BOARDS}, {s_label('flag_A', 'la')}, {s_label('flag_N', 'ln')}, {s_label('flag_R', 'lr')},
    u AS (SELECT 'flag_A' AS board, value FROM la UNION ALL SELECT 'flag_N', value FROM ln UNION ALL SELECT 'flag_R', value FROM lr)
    SELECT board, count(value) AS n_labelled, count(*) AS n_models, CASE WHEN count(value) < 12 THEN 'too few labelled models' END AS skip FROM u GROUP BY 1""",
)
def label_coverage(spark, sf):
    """Task pre-filter: labelled models per board, with the reason a board is skipped."""
    b = boards(spark, sf)
    n_models = T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    got = L.labels_long(T.models(spark, sf), b, aliases(spark, sf)).groupBy("board").agg(F.count(F.lit(1)).alias("n"))
    return (
        b.select("board").distinct().join(got, "board", "left")
        .select("board", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_labelled"), n_models.alias("n_models"))
        .withColumn("skip", F.when(F.col("n_labelled") < 12, "too few labelled models"))
    )


@query(
    "board_shortlist",
    f"""WITH {MODELS}, {BOARDS}, {s_label('flag_A', 'la')}, {s_label('flag_N', 'ln')},
    u AS (SELECT 'flag_N' AS board, 1 AS pos, model_id, value FROM ln WHERE value IS NOT NULL UNION ALL SELECT 'flag_A', 2, model_id, value FROM la WHERE value IS NOT NULL),
    pick AS (SELECT board, count(*) AS n FROM u GROUP BY board, pos HAVING count(*) >= 20 ORDER BY pos LIMIT 1),
    r AS (SELECT u.*, least(10, n // 3) AS k, row_number() OVER (ORDER BY value DESC, model_id) AS rn FROM u JOIN pick USING (board))
    SELECT board, model_id, round(value, 6) AS value, (rn <= k)::INT AS label, k::BIGINT AS k FROM r""",
)
def board_shortlist(spark, sf):
    """The first board that lists enough models, its top min(10, n/3) marked."""
    b = boards(spark, sf).filter(F.col("board").isin("flag_N", "flag_A"))
    labels = L.labels_long(T.models(spark, sf), b, aliases(spark, sf)).withColumn(
        "pos", F.when(F.col("board") == "flag_N", 1).otherwise(2)
    )
    return rounded(L.shortlist(labels).select("board", "model_id", "value", "label", "k"), "value")


# ------------------------------------------------ footprints
DTYPES = ["fp32", "fp16", "bf16", "fp8", "awq", "gptq"]


def footprints(spark, sf):
    """A part is one footprint entry of the supplier its key names."""
    s = T.table(spark, sf, "supplier")
    n = s.agg(F.count(F.lit(1))).scalar()
    p = T.table(spark, sf, "part").withColumn("s_suppkey", F.col("p_partkey") % n)
    dt = F.array(*[F.lit(d) for d in DTYPES])
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.join(s.select("s_suppkey", "s_name"), "s_suppkey").select(
        k.alias("pos"),
        F.when(size % 3 == 0, F.concat(F.lit("Org__"), "s_name")).when(size % 3 == 1, F.concat("s_name", F.lit("-awq"))).otherwise(F.lit("misc")).alias("dir"),
        F.when(size % 2 == 0, F.concat(F.lit("Hub/"), "s_name")).alias("hf_id"),
        F.when(size % 7 != 0, F.get(dt, (k % 6).cast("int"))).alias("quant"),
        F.when(size % 5 != 0, F.get(dt, (k % 5).cast("int"))).alias("serve_quant"),
        size.cast("double").alias("params_b"),
        F.when(size % 4 != 0, F.col("p_retailprice") * 1e7).alias("weight_bytes"),
        F.when(size % 2 == 0, "estimated").alias("status"),
    )


def rk(n: str) -> str:
    return f"lower(trim(list_extract(string_split(list_extract(string_split({n}, '/'), -1), '__'), -1)))"


def s_width(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in X.BYTES_PER_PARAM.items()) + " END"


FOOT = f"""fp AS (SELECT p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'Org__' || s_name WHEN 1 THEN s_name || '-awq' ELSE 'misc' END AS dir,
   CASE WHEN p_size % 2 = 0 THEN 'Hub/' || s_name END AS hf_id, CASE WHEN p_size % 7 <> 0 THEN {DTYPES}[1 + p_partkey % 6] END AS quant,
   CASE WHEN p_size % 5 <> 0 THEN {DTYPES}[1 + p_partkey % 5] END AS serve_quant, p_size::DOUBLE AS params_b,
   CASE WHEN p_size % 4 <> 0 THEN p_retailprice * 1e7::DOUBLE END AS weight_bytes, CASE WHEN p_size % 2 = 0 THEN 'estimated' END AS status
   FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
  fk AS (SELECT DISTINCT fp.*, unnest([{rk('dir')}, {rk('hf_id')}]) AS key FROM fp),
  foot AS (SELECT model_id, fk.* FROM fk JOIN models ON fk.key = {rk('name')}
    QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY (status IS NOT NULL)::INT, ({rk('dir')} <> fk.key)::INT, dir, pos) = 1),
  vram AS (SELECT *, CASE WHEN weight_bytes > 0 AND quant IS NOT NULL THEN weight_bytes * ({s_width('serve_quant')}) / ({s_width('quant')}) / 1e9::DOUBLE
     WHEN params_b > 0 THEN params_b * 1e9::DOUBLE * ({s_width('serve_quant')}) / 1e9::DOUBLE END AS gb FROM foot)"""


@query(
    "select_footprints",
    f"WITH {MODELS}, {FOOT} SELECT model_id, pos, dir, hf_id, status FROM foot",
)
def select_footprints(spark, sf):
    return L.select_footprints(T.models(spark, sf), footprints(spark, sf)).select("model_id", "pos", "dir", "hf_id", "status")


@query(
    "model_metadata",
    f"""WITH {MODELS}, {FOOT}, d AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS model_id, min(o_orderdate) AS at FROM orders GROUP BY 1)
    SELECT m.model_id, round(gb, 6) AS vram_gb, foot.params_b, coalesce(strftime(d.at, '%Y-%m-%d'), '') AS release_date, m.family,
      (contains(lower(m.name), '7') OR contains(lower(m.name), '#00000000'))::INT AS is_chat
    FROM models m LEFT JOIN vram USING (model_id) LEFT JOIN foot USING (model_id) LEFT JOIN d USING (model_id)""",
)
def model_metadata(spark, sf):
    """VRAM, size, date, family and tuning flag joined onto the model axis; unresolved is NULL or ""."""
    m = T.models(spark, sf).select("model_id", "name", "family")
    foot = L.select_footprints(m, footprints(spark, sf)).select(
        "model_id", "params_b",
        F.round(X.served_vram_gb(F.col("weight_bytes"), F.col("quant"), F.col("serve_quant"), F.col("params_b")), 6).alias("vram_gb"),
    )
    n = T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    dates = T.table(spark, sf, "orders").groupBy((F.col("o_custkey") % n).alias("model_id")).agg(
        X.iso_date(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")).alias("release_date")
    )
    return m.join(foot, "model_id", "left").join(dates, "model_id", "left").select(
        "model_id", "vram_gb", "params_b", F.coalesce("release_date", F.lit("")).alias("release_date"), "family",
        contains_any("name", ("7", "#00000000")).cast("int").alias("is_chat"),
    )


RAW_DATE = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '2024-02-30' WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13-01' WHEN 4 THEN 'soon' END"


def raw_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(k % 6 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 6 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 6 == 2, F.lit("2024-02-30"))
        .when(k % 6 == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-13-01")))
        .when(k % 6 == 4, F.lit("soon"))
    )
    return T.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


@query(
    "release_dates",
    f"""WITH r AS (SELECT o_orderkey, {RAW_DATE} AS raw FROM orders), p AS (SELECT *, left(trim(raw), 10) AS hd FROM r),
    s AS (SELECT *, TRY_CAST(regexp_extract(hd, '^(\\d+)-(\\d+)-(\\d+)$', 2) AS INT) AS m, TRY_CAST(regexp_extract(hd, '^(\\d+)-(\\d+)-(\\d+)$', 3) AS INT) AS d FROM p)
    SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN hd ELSE '' END AS date FROM s""",
)
def release_dates(spark, sf):
    return raw_dates(spark, sf).select("o_orderkey", X.iso_date(F.col("raw")).alias("date"))


@query(
    "upload_age",
    f"""WITH r AS (SELECT o_orderkey, {RAW_DATE} AS raw FROM orders)
    SELECT o_orderkey, round(epoch_us(TRY_CAST(raw AS TIMESTAMPTZ) ) / 86400000000.0::DOUBLE - epoch_us(TIMESTAMPTZ '2022-01-01 00:00:00+00') / 86400000000.0::DOUBLE, 6) AS days FROM r""",
)
def upload_age(spark, sf):
    return raw_dates(spark, sf).select("o_orderkey", F.round(X.days_since_epoch(F.col("raw")), 6).alias("days"))


@query(
    "benchmark_dates",
    """WITH b AS (SELECT lower(p_type) || '_' || lower(p_brand) || '_' || p_size AS bench, count(*) AS n FROM part GROUP BY 1),
    s AS (SELECT lower(p_type) AS suite, '2019-0' || length(p_type) || '-01' AS date FROM part WHERE p_type <> 'PROMO' GROUP BY p_type
      UNION ALL SELECT lower(p_type) || '_' || lower(p_brand), '2021-01-' || lpad(replace(p_brand, 'Brand#', ''), 2, '0') FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY p_type, p_brand)
    SELECT bench, n, coalesce((SELECT arg_max(date, length(suite)) FROM s WHERE bench = suite OR starts_with(bench, suite || '_')), '') AS published FROM b""",
)
def benchmark_dates(spark, sf):
    p = T.table(spark, sf, "part")
    bench = p.groupBy(F.concat_ws("_", F.lower("p_type"), F.lower("p_brand"), F.col("p_size").cast("string")).alias("bench")).agg(F.count(F.lit(1)).alias("n"))
    coarse = p.filter("p_type <> 'PROMO'").select(
        F.lower("p_type").alias("suite"), F.concat(F.lit("2019-0"), F.length("p_type").cast("string"), F.lit("-01")).alias("date")
    ).distinct()
    fine = p.filter(F.col("p_brand").startswith("Brand#1")).select(
        F.concat_ws("_", F.lower("p_type"), F.lower("p_brand")).alias("suite"),
        F.concat(F.lit("2021-01-"), F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 2, "0")).alias("date"),
    ).distinct()
    return L.prefix_dates(bench, coarse.unionByName(fine), "bench")


# ------------------------------------------------ cards
CARD = (
    "ok boolean, architecture struct<model_type: string, max_position_embeddings: bigint>, "
    "popularity struct<downloads: bigint, likes: bigint>, metadata struct<license: string, tags: array<string>>, "
    "timestamps struct<createdAt: string>, _bad string"
)
LICENSES = ("apache-2.0", " MIT ", "llama3", "", "cc-by-nc-4.0", "gpl-3.0", "other")


def raw_cards(spark, sf):
    """A customer is one model card, as JSON text; some are malformed and some not ok."""
    k = F.col("c_custkey")
    lic = F.get(F.array(*[F.lit(x) for x in LICENSES]), (k % len(LICENSES)).cast("int"))
    text = F.format_string(
        '{"ok": %s, "architecture": {"model_type": "%s", "max_position_embeddings": %d}, "popularity": {"downloads": %d, "likes": %d}, '
        '"metadata": {"license": "%s", "tags": ["a", "b"]}, "timestamps": {"createdAt": "20%s-0%d-11T00:00:00.000Z"}}',
        F.when(k % 9 == 4, "false").otherwise("true"), F.initcap("c_mktsegment"), k * 64,
        F.col("c_acctbal").cast("bigint"), k % 50, lic, F.lpad((k % 5 + 20).cast("string"), 2, "0"), k % 9 + 1,
    )
    return T.table(spark, sf, "customer").select(k.alias("card_id"), F.when(k % 11 == 7, F.lit('{"ok": tru')).otherwise(text).alias("json"))


def cards(spark, sf):
    """Parsed cards: malformed text is a missing card, and only ok cards count."""
    c = F.from_json("json", CARD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw_cards(spark, sf).select("card_id", c.alias("c")).filter(F.col("c._bad").isNull() & F.col("c.ok"))


S_CARDS = f"""cards AS (SELECT c_custkey AS card_id, c_mktsegment AS seg, (c_custkey * 64) AS ctx, c_acctbal::BIGINT AS _r,
   trunc(c_acctbal)::BIGINT AS downloads, [{', '.join(q(x) for x in LICENSES)}][1 + c_custkey % {len(LICENSES)}] AS lic,
   make_timestamp(2020 + (c_custkey % 5)::BIGINT, 1 + (c_custkey % 9)::BIGINT, 11, 0, 0, 0.0) AS ts
   FROM customer WHERE c_custkey % 11 <> 7 AND c_custkey % 9 <> 4)"""


@query(
    "card_columns",
    f"""WITH {S_CARDS} SELECT card_id, round(CASE WHEN downloads >= 0 THEN log10(1 + downloads) END, 6) AS downloads, round(CASE WHEN ctx > 0 THEN log2(ctx) END, 6) AS context_length,
      round(date_diff('day', TIMESTAMP '2022-01-01', ts)::DOUBLE, 6) AS upload_days, lower(seg) AS architecture_family,
      CASE WHEN lic = '' THEN 'unknown' WHEN lower(trim(lic)) IN ('apache-2.0', 'mit', 'gpl-3.0') THEN 'permissive' ELSE 'restrictive' END AS license_type FROM cards""",
)
def card_columns(spark, sf):
    out = cards(spark, sf).select(
        "card_id",
        X.log10_1p(F.col("c.popularity.downloads").cast("double")).alias("downloads"),
        X.log2(F.col("c.architecture.max_position_embeddings").cast("double")).alias("context_length"),
        X.days_since_epoch(F.col("c.timestamps.createdAt")).alias("upload_days"),
        X.architecture_family(F.col("c.architecture.model_type")).alias("architecture_family"),
        X.license_type(F.col("c.metadata.license")).alias("license_type"),
    )
    return rounded(out, "downloads", "context_length", "upload_days")


@query(
    "card_classes",
    f"""WITH {S_CARDS} SELECT lower(seg) AS architecture_family, count(*) AS n FROM cards GROUP BY 1 HAVING count(*) >= 30""",
)
def card_classes(spark, sf):
    """Classes with enough members."""
    fam = cards(spark, sf).select(X.architecture_family(F.col("c.architecture.model_type")).alias("architecture_family"))
    return L.usable_classes(fam, "architecture_family", 30)


@query(
    "class_counts",
    f"""WITH {S_CARDS}, l AS (SELECT CASE WHEN lic = '' THEN 'unknown' WHEN lower(trim(lic)) IN ('apache-2.0', 'mit', 'gpl-3.0') THEN 'permissive' ELSE 'restrictive' END AS license_type FROM cards)
    SELECT license_type, count(*) AS n FROM l WHERE license_type <> 'unknown' GROUP BY 1""",
)
def class_counts(spark, sf):
    lic = cards(spark, sf).select(X.license_type(F.col("c.metadata.license")).alias("license_type"))
    return L.class_counts(lic, "license_type")


@query(
    "finite_values",
    f"""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice::VARCHAR WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE '1e400' END AS t FROM orders)
    SELECT o_orderkey, round(CASE WHEN isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END, 6) AS value FROM v""",
)
def finite_values(spark, sf):
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "n/a").when(k == 2, "NaN").when(k == 4, "1e400")
    return T.table(spark, sf, "orders").select("o_orderkey", F.round(X.finite(t), 6).alias("value"))


# ------------------------------------------------ per-cell measures
def measures(spark, sf):
    """measures(model_id, question_id, rm, correct, n_tok): a reward score per cell."""
    line = T.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("model_id"), F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_quantity", "l_linenumber"
    )
    part = T.table(spark, sf, "part").select("p_partkey", T.question_id().alias("question_id"))
    bit = F.avg((F.col("l_quantity") > 25).cast("int"))
    return line.join(part, "p_partkey").groupBy("model_id", "question_id").agg(
        (F.avg("l_extendedprice") / 10000.0).alias("rm"),
        (bit > 0.5).cast("int").alias("correct"),
        F.avg("l_linenumber").alias("n_tok"),
    )


MEASURES = """measures AS (SELECT l_suppkey AS model_id, p_brand || '|' || p_type AS question_id, avg(l_extendedprice) / 10000.0::DOUBLE AS rm,
   (avg((l_quantity > 25)::INT) > 0.5)::INT AS correct, avg(l_linenumber) AS n_tok FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query(
    "correctness_residual",
    f"""WITH {MEASURES}, t AS (SELECT question_id, rm AS y, correct::DOUBLE AS c FROM measures WHERE model_id % 5 <> 0),
    s AS (SELECT question_id, count(*) AS n, sum(y) AS sy, sum(c) AS sc, sum(c * c) AS scc, sum(c * y) AS scy, max(c) - min(c) < 1e-9 AS flat, avg(y) AS my FROM t GROUP BY 1),
    f AS (SELECT *, n + 1e-6 * (n + scc) / 2 AS a, scc + 1e-6 * (n + scc) / 2 AS d FROM s)
    SELECT model_id, m.question_id, round(CASE WHEN n < 4 THEN NULL WHEN flat THEN rm - my ELSE rm - ((d * sy - sc * scy) + (a * scy - sc * sy) * correct) / (a * d - sc * sc) END, 6) AS residual
    FROM measures m JOIN f USING (question_id)""",
)
def correctness_residual(spark, sf):
    """Reward with the per-question correctness effect removed, fitted on the training models."""
    out = L.correctness_residual(measures(spark, sf), F.col("model_id") % 5 != 0)
    return rounded(out.select("model_id", "question_id", "residual"), "residual")


@query(
    "scored_models",
    f"WITH {MEASURES} SELECT model_id, count(rm) AS n_cells, round(avg(rm), 6) AS rm_mean FROM measures GROUP BY 1 HAVING count(rm) >= 50",
)
def scored_models(spark, sf):
    out = measures(spark, sf).groupBy("model_id").agg(F.count("rm").alias("n_cells"), F.avg("rm").alias("rm_mean"))
    return rounded(out.filter("n_cells >= 50"), "rm_mean")


@query(
    "board_sources",
    f"""WITH {BOARDS} SELECT board, count(*) AS n_rows, count(DISTINCT name) AS n_names, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM boards GROUP BY 1""",
)
def board_sources(spark, sf):
    """Per-source coverage of a union of published boards."""
    out = boards(spark, sf).groupBy("board").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("name").alias("n_names"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return rounded(out, "lo", "hi")


