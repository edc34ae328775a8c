"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm import centroids, decontaminate, html_text, mixing, pii, quality, resampling, simhash, token_shards, toxicity, url_filter, vectors, warc
from reconlake.plans.lineage import written
from reconlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: Host labels of the block list.
SPAM_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query(
    "op10_url_filter",
    """
    with parts as (
      select page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
    rules(verdict, h, p) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                                    ('allow','com','/fr/'), ('block','com','/de/')),
    fits as (
      select parts.host, parts.path, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
      from (select distinct host, path from parts) parts join rules
        on (parts.host = h or ends_with(parts.host, '.' || h)) and starts_with(parts.path, p)
      group by 1, 2)
    select page_id, parts.host, parts.path, fits.rule,
      coalesce(fits.verdict, case when list_has_any(string_split(parts.host, '.'),
        ['adult-x','ads-track','casino-win','cheap-pills','free-bets','spam-farm']) then 'block' else 'allow' end) as verdict
    from parts left join fits on parts.host = fits.host and parts.path = fits.path
    """,
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = F.array(*map(F.lit, SPAM_LABELS))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.where(F.arrays_overlap(F.split("key", "[.]"), labels))
    return url_filter.judge(pages, RULES, listed)


#: The key of a real run comes from the deployment; this one makes the query repeatable.
PII_KEY = "demonstration key"


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


MIX_SHARES = {
    "source": None,
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.7, "listing": 0.1, "notice": 0.1, "contact": 0.1},
}
MIX_BUDGET = 0.5

MIX_SQL = """
    with recursive d as (
      select doc_id, source, lang,
        case when contains(text, 'Licensed under') then 'notice' when contains(text, ' | ') then 'listing'
             when contains(text, '@') then 'contact' else 'prose' end as topic,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens
      from documents),
    cells as (select source, lang, topic, sum(tokens)::double as tokens from d group by all having sum(tokens) > 0),
    ts as (select source, sqrt(sum(tokens)) as raw from cells group by 1),
    named(dim, v, share) as (values ('l','en',0.4::double),('l','de',0.2),('l','fr',0.2),('l','es',0.2),
                                    ('t','prose',0.7),('t','listing',0.1),('t','notice',0.1),('t','contact',0.1)),
    tl as (select lang, coalesce(share, 0) as raw from (select distinct lang from cells) left join named on dim = 'l' and v = lang),
    tt as (select topic, coalesce(share, 0) as raw from (select distinct topic from cells) left join named on dim = 't' and v = topic),
    start as (
      select c.*, ts.raw / (select sum(raw) from ts) as t_s, tl.raw / (select sum(raw) from tl) as t_l, tt.raw / (select sum(raw) from tt) as t_t
      from cells c join ts on c.source is not distinct from ts.source join tl on c.lang is not distinct from tl.lang join tt using (topic)),
    ipf as (
      select *, tokens as share, 0 as step from start
      union all
      select source, lang, topic, tokens, t_s, t_l, t_t,
        case step % 3
          when 0 then share * t_s / sum(share) over (partition by source)
          when 1 then share * t_l / sum(share) over (partition by lang)
          else share * t_t / sum(share) over (partition by topic) end,
        step + 1
      from ipf where step < 36),
    rates as (
      select source, lang, topic, share / sum(share) over () * 0.5 * sum(tokens) over () / tokens as ratio from ipf where step = 36),
    p as (
      select d.*, least(coalesce(ratio, 0), 1) as p from d left join rates r
        on d.source is not distinct from r.source and d.lang is not distinct from r.lang and d.topic = r.topic)
    select doc_id, source, lang, topic, tokens, round(p * 1e9)::bigint as probability_ppb,
      ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double < p as sampled
    from p
    """


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    # Counted once and kept narrow: the raking and the draw then read no text.
    narrow = written(docs.select("doc_id", "source", "lang", mixing.topic_of(text).alias("topic"), mixing.n_words(text).alias("tokens")), "mixing")
    mixed = mixing.mix(narrow, MIX_SHARES, MIX_BUDGET)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round(F.col("probability") * 1e9).cast("bigint").alias("probability_ppb"), "sampled")


@query(
    "op3_decontaminate",
    """
    with words_of as (
      select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
      from benchmark),
    windows as (
      select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
      from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from words_of where len(w) > 0)),
    docs as (
      select row_number() over () as r, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
      from documents),
    places as (select r, w, unnest(range(1, len(w) + 1)) as i from docs),
    grams as (
      select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g
      from places cross join (select distinct n from windows) where i + n - 1 <= len(w)),
    hits as (select r, i, grams.n, item_id from grams join windows on grams.n = windows.n and grams.g = windows.g),
    hit_words as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hits) group by r),
    hit_items as (
      select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
      from (select distinct r, item_id::varchar as id from hits where item_id is not null) group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
      sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit_words using (r) left join hit_items using (r)
    """,
)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("hit_spans"))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).drop("text", "lang")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).drop("html")


@query(
    "op9_warc",
    """
    with p as (
      select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha,
        max(page_id) over (partition by sha1(coalesce(html, ''))) as largest
      from pages)
    select page_id, strlen(html)::bigint as payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
      case when page_id = largest or largest is null then 'response' else 'revisit' end as record_type,
      case when page_id = largest or largest is null then null else largest end as refers_to
    from p
    """,
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, bits=64, radius=2, ratio=0.0, repeats=True)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


ORDER_KEY = "first epoch"


@query("op7_token_shards")
def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards(table(spark, sf_dir, "documents"), ORDER_KEY)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(), toxicity.MAX_ROWS, toxicity.MAX_BYTES)
    return toxicity.score(docs, toxicity.fit(known)).withColumn("held_out", held_out())


CENTROIDS, ROUNDS, CENTROID_SEED, WIDTH = 8, 10, 3, 64


def _centroid_sql() -> str:
    """Every vector against every centroid, round by round."""
    gap = "list_sum(list_transform(list_zip(v.c, k.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    parts = [
        f"""v as materialized (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as c from embeddings
          where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0)""",
        f"""c0 as materialized (select row_number() over (order by h, c) - 1 as j, c from (
          select sha256('{CENTROID_SEED}:' || coalesce(vec_id::varchar, '')) as h, c from v order by h, c limit {CENTROIDS}))""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} as materialized (select r, vec_id, c, n.j, n.d from (select v.r, v.vec_id, v.c, min({{'d': {gap}, 'j': k.j}}) as n from v, c{i} k group by all))")
        if i < ROUNDS:
            parts.append(f"""m{i} as (select j, list(m order by p) as c from (
              select j, p, (sum(x::hugeint) - ((sum(x::hugeint) % count(*)) + count(*)) % count(*)) // count(*) as m
              from (select j, unnest(c) as x, generate_subscripts(c, 1) as p from a{i}) group by j, p) group by j)""")
            parts.append(f"c{i + 1} as materialized (select k.j, coalesce(m.c::bigint[], k.c) as c from c{i} k left join m{i} m on m.j = k.j)")
    return f"""with {", ".join(parts)}
      select a.vec_id, a.j::int as cluster, a.d as distance, (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
        sha256(array_to_string(k.c, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} k on a.j = k.j"""


@query("op11_centroids", _centroid_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, places = centroids.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, CENTROID_SEED, WIDTH)
    return centroids.with_inertia(rows, places)


DRAW_PERCENT, DRAW_SEED, DRAW_WORDS, DRAW_BUCKETS = 10, 2024, 20, 10_000


@query(
    "op12_resampling",
    """
    with crc as (
      select list(c order by i) as t from (
        select i, list_reduce([i] || [0::bigint for _ in range(8)], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    docs as (
      select row_number() over () as r, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
      from documents),
    items as (
      select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w
      from benchmark),
    places as (select r, unnest(w) as w from docs),
    words as (select distinct w, hex(encode(w)) as x from (select w from places union all select w from items)),
    hashed as (
      select w, xor(list_reduce([4294967295] || [('0x' || substr(x, (2 * i + 1)::int, 2))::bigint for i in range(len(x) // 2)],
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as b from words, crc),
    s as (select b, count(*) as n from places join hashed using (w) group by 1),
    t as (select b, count(*) as n from items join hashed using (w) group by 1),
    gain as (
      select b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000))::double / ((s.n + 1) * ((select coalesce(sum(n), 0) from t) + 10000))::double))::bigint as g
      from s left join t using (b)),
    sums as (select r, sum(g) as g, count(*) as n from places join hashed using (w) join gain using (b) group by 1),
    weighed as (
      select doc_id, len(w)::bigint as n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::bigint as weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
      from docs left join sums using (r)),
    scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296.0::double)))::bigint as score from weighed),
    placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as place, count(*) over (partition by n_features >= 20) as n from scored)
    select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
    """,
)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target, DRAW_PERCENT, DRAW_SEED, 1, DRAW_BUCKETS, DRAW_WORDS).select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op13_vectors",
    """
    with recursive rows as (select row_number() over () as r, vec_id, embedding::double[] as v from embeddings),
    good as materialized (select r, vec_id, v from rows where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(v, lambda x: abs(x))) > 0),
    links as materialized (select a.r as x, b.r as y, b.vec_id from good a join good b on a.r <> b.r and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
    reach as (select r, r as y from good union select reach.r, links.y from reach join links on reach.y = links.x),
    least as (select reach.r, min(vec_id) as component_id from reach join rows on rows.r = reach.y group by 1),
    n as (select x, count(*) as n from links group by 1)
    select vec_id, coalesce(n, 0)::bigint as n_links, case when least.r is null then vec_id else component_id end as component_id,
      vec_id is not distinct from case when least.r is null then vec_id else component_id end as kept
    from rows left join n on x = rows.r left join least on least.r = rows.r
    """,
)
def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
