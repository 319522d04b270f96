"""News, social, policy and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import datasets as data
from ..functions import text as tx
from ..operators import text as ops
from .base import Catalogue
from .tables_sql import ASSETS, GOV_EVENTS, NEWS, clip, r, rs, with_

CATALOGUE = Catalogue()
add = CATALOGUE.add

# frequent words of the given prose stand in for the finance lexicon
POS, NEG = ("the", "of", "and", "le", "der"), ("to", "in", "that", "la", "die")
AS_OF = "2024-01-31 00:00:00"
KEY = "SUBSTRING(TRIM(REGEXP_REPLACE(LOWER(title), '[^a-z0-9 ]', '', 'g'), ' '), 1, 90)"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def news(spark, sf_dir):
    """Headlines with trust order by provider and their position in the feed."""
    df = data.news(spark, sf_dir)
    order = F.regexp_extract("provider", r"(\d+)", 1).try_cast("int")
    return df.withColumn("priority", F.coalesce(order, F.lit(99))).withColumn("position", F.col("news_id")).withColumn(
        "url", F.concat(F.lit("https://news.example/"), F.col("news_id").cast("string"))
    )


def keyed_news(spark, sf_dir):
    """Headlines with the key of their title in place of the text."""
    return news(spark, sf_dir).withColumn("title_key", tx.title_key(F.col("title"))).drop("title")


NEWS_O = f"""news_o AS (SELECT *, COALESCE(TRY_CAST(REGEXP_EXTRACT(provider, '(\\d+)', 1) AS INT), 99) AS priority, 'https://news.example/' || CAST(news_id AS VARCHAR) AS url, {KEY} AS tkey FROM news)"""
MERGED = f"""merged AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, tkey ORDER BY priority, news_id) AS rn FROM news_o WHERE tkey <> '') WHERE rn = 1 AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)"""


@add("title_keys", with_(NEWS, NEWS_O, select="SELECT news_id, tkey AS title_key FROM news_o"))
def title_keys(spark, sf_dir):
    return news(spark, sf_dir).select("news_id", tx.title_key(F.col("title")).alias("title_key"))


@add("merged_headlines", with_(NEWS, NEWS_O, MERGED, select="""
SELECT ticker, tkey AS title_key, news_id, provider, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM merged"""))
def merged_headlines(spark, sf_dir):
    """Deduplicated headlines of the last day per ticker."""
    kept = ops.merge_feeds(keyed_news(spark, sf_dir), as_of(), 24)
    return kept.select("ticker", "title_key", "news_id", "provider", "published_at")


@add("newest_headlines", with_(NEWS, NEWS_O, MERGED, select="""
SELECT * FROM (SELECT ticker, news_id, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_at DESC, priority, news_id) AS rank FROM merged) WHERE rank <= 15"""))
def newest_headlines(spark, sf_dir):
    """The fifteen newest merged headlines of each ticker."""
    kept = ops.merge_feeds(keyed_news(spark, sf_dir), as_of(), 24)
    return ops.newest(kept, "ticker", 15).select("ticker", "news_id", "rank")


@add("deduped_titles", with_(NEWS, NEWS_O, select="""
SELECT tkey AS title_key, MIN_BY(news_id, {'p': priority, 'i': news_id}) AS news_id, COUNT(*) AS copies FROM news_o WHERE tkey <> '' GROUP BY 1"""))
def deduped_titles(spark, sf_dir):
    """First item per title over all feeds, with the number of copies."""
    items = keyed_news(spark, sf_dir)
    first = ops.dedupe_titles(items.select("news_id", "title_key", "priority", "position"), [], ["priority", "position"])
    copies = items.groupBy("title_key").agg(F.count(F.lit(1)).alias("copies"))
    return first.select("title_key", "news_id").join(copies, "title_key")


@add("headline_providers", with_(NEWS, NEWS_O, select="SELECT ticker, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT provider)), '; ') AS providers FROM news_o GROUP BY ticker"))
def headline_providers(spark, sf_dir):
    return ops.providers(news(spark, sf_dir), "ticker")


@add("recency_filters", with_(NEWS, NEWS_O, select=f"""
SELECT provider, SUM(CASE WHEN published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 1 ELSE 0 END)::BIGINT AS strict_24h, SUM(CASE WHEN published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY THEN 1 ELSE 0 END)::BIGINT AS lenient_2d FROM news_o GROUP BY provider"""))
def recency_filters(spark, sf_dir):
    p = F.col("published_at")
    strict = F.coalesce(ops.recent_strict(p, as_of(), 24), F.lit(False))
    lenient = ops.recent_lenient(p, as_of(), 2)
    return news(spark, sf_dir).groupBy("provider").agg(
        F.sum(strict.cast("long")).alias("strict_24h"), F.sum(lenient.cast("long")).alias("lenient_2d")
    )


_terms = " OR ".join(f"CONTAINS(LOWER(text), '{t}')" for t in tx.MARKET_TERMS)


@add("market_relevant", f"SELECT doc_id, source FROM documents WHERE {_terms}")
def market_relevant(spark, sf_dir):
    """Documents whose whole text contains a market term."""
    docs = data.table(spark, sf_dir, "documents")
    return docs.where(tx.has_any(F.col("text"), tx.MARKET_TERMS)).select("doc_id", "source")


_stop = ", ".join(f"'{w}'" for w in tx.COMPANY_STOPWORDS)
TOKS = f"""ctok AS (SELECT ticker, UNNEST(LIST_DISTINCT(LIST_FILTER(REGEXP_EXTRACT_ALL(LOWER(company_name), '[a-z0-9&]+'), lambda t: LENGTH(t) >= 4 AND NOT LIST_CONTAINS([{_stop}], t)))) AS tok FROM assets)"""


@add("entity_relevance", with_(NEWS, NEWS_O, ASSETS, TOKS, select="""
SELECT DISTINCT n.news_id, c.ticker FROM news_o n JOIN ctok c ON CONTAINS(LOWER(n.title || ' ' || n.url), c.tok)
UNION SELECT n.news_id, a.ticker FROM news_o n JOIN assets a ON REGEXP_MATCHES(UPPER(n.title || ' ' || n.url), '(^|[^A-Z0-9])' || REPLACE(REPLACE(UPPER(a.ticker), '#', '\\#'), '.', '\\.') || '($|[^A-Z0-9])')"""))
def entity_relevance(spark, sf_dir):
    """Headlines attached to the companies they name."""
    return ops.attach_entities(news(spark, sf_dir), data.assets(spark, sf_dir))


@add("market_context", with_(ASSETS, select="""
SELECT ticker, UPPER(ticker) IN ('SPX', 'XSP', 'NDX', 'XND', 'RUT', 'VIX', 'DJX', 'OEX', 'SPY', 'QQQ', 'DIA', 'IWM') OR CONTAINS(LOWER(company_name), 'index') OR CONTAINS(LOWER(company_name), 's&p') OR CONTAINS(LOWER(company_name), 'nasdaq')
  OR CONTAINS(LOWER(company_name), 'russell') OR CONTAINS(LOWER(company_name), 'dow jones') AS is_market FROM assets"""))
def market_context(spark, sf_dir):
    return data.assets(spark, sf_dir).select("ticker", tx.market_context(F.col("ticker"), F.col("company_name")).alias("is_market"))


def _words_sql(text: str, edge: str) -> str:
    cls = "[" + "".join("\\" + c for c in edge).replace("'", "''") + "]"
    return f"LIST_DISTINCT(LIST_TRANSFORM(LIST_FILTER(STRING_SPLIT_REGEX({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: LOWER(REGEXP_REPLACE(w, '^{cls}+|{cls}+$', '', 'g'))))"


def _hits_sql(words: str, lexicon) -> str:
    lex = ", ".join(f"'{w}'" for w in lexicon)
    return f"LENGTH(LIST_INTERSECT({words}, [{lex}]))"


def polarity_cte(positive, negative, edge=tx.NEWS_EDGE) -> str:
    return f"""pol0 AS (SELECT *, {_words_sql('title', edge)} AS ws FROM news_o),
pol1 AS (SELECT * EXCLUDE (ws), {_hits_sql('ws', positive)} AS p, {_hits_sql('ws', negative)} AS n FROM pol0),
pol AS (SELECT *, CASE WHEN p = n THEN 0 ELSE (p - n)::DOUBLE / NULLIF(p + n, 0) END AS polarity FROM pol1)"""


POL = polarity_cte(POS, NEG)


@add("headline_polarity", with_(NEWS, NEWS_O, POL, select=f"SELECT news_id, {r('polarity')} AS polarity FROM pol"))
def headline_polarity(spark, sf_dir):
    return news(spark, sf_dir).select("news_id", tx.polarity(F.col("title"), POS, NEG).alias("polarity"))


def posts(spark, sf_dir):
    """Conversation turns as posts about a ticker, classed by the lexicon."""
    turns = data.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", "role",
        F.concat(F.lit("Brand#"), (1 + F.col("conv_id") % 25).cast("string")).alias("ticker"),
        tx.post_class(F.col("text"), POS, NEG).alias("label"),
    )


POSTS = f"""posts AS (SELECT conv_id, turn, role, 'Brand#' || CAST(1 + conv_id % 25 AS VARCHAR) AS ticker, SIGN({_hits_sql('ws', POS)}::INT - {_hits_sql('ws', NEG)}::INT)::BIGINT AS label FROM (SELECT *, {_words_sql('text', tx.POST_EDGE)} AS ws FROM conversations))"""


@add("post_classes", with_(POSTS, select="SELECT conv_id, turn, role, label FROM posts"))
def post_classes(spark, sf_dir):
    return posts(spark, sf_dir).select("conv_id", "turn", "role", "label")


TALLY = f"""tally AS (SELECT ticker, role, COUNT(*) AS message_count, SUM(CASE WHEN label > 0 THEN 1 ELSE 0 END)::BIGINT AS bullish, SUM(CASE WHEN label < 0 THEN 1 ELSE 0 END)::BIGINT AS bearish FROM posts GROUP BY 1, 2),
mood AS (SELECT *, COALESCE({rs('(bullish - bearish)::DOUBLE / NULLIF(bullish + bearish, 0)', 3)}, 0) AS net_sentiment FROM tally)"""


def moods(spark, sf_dir):
    return ops.label_tally(posts(spark, sf_dir), ["ticker", "role"])


@add("social_mood", with_(POSTS, TALLY, select="SELECT ticker, role, message_count, bullish, bearish, net_sentiment FROM mood"))
def social_mood(spark, sf_dir):
    return moods(spark, sf_dir)


NEWS_MOOD = f"""nmood AS (SELECT ticker, COUNT(*) AS message_count, SUM(CASE WHEN p > n THEN 1 ELSE 0 END)::BIGINT AS bullish, SUM(CASE WHEN n > p THEN 1 ELSE 0 END)::BIGINT AS bearish FROM pol GROUP BY 1),
allm AS (SELECT ticker, role AS source, CASE role WHEN 'user' THEN 1 ELSE 2 END AS pr, CASE WHEN LENGTH(ticker) % 2 = 0 THEN message_count ELSE 0 END AS message_count, bullish, bearish, net_sentiment FROM mood
  UNION ALL SELECT ticker, 'news_derived', 9, message_count, bullish, bearish, COALESCE({rs('(bullish - bearish)::DOUBLE / NULLIF(bullish + bearish, 0)', 3)}, 0) FROM nmood)"""


def chosen_mood(spark, sf_dir):
    """Best available mood source per ticker; the news-derived one is last.

    Social sources count no messages for the tickers of odd length, so both ways occur.
    """
    social = moods(spark, sf_dir)
    social = social.withColumn("message_count", F.when(F.length("ticker") % 2 == 0, F.col("message_count")).otherwise(0))
    social = social.withColumnRenamed("role", "source").withColumn("priority", F.when(F.col("source") == "user", 1).otherwise(2))
    from_news = news(spark, sf_dir).withColumn("label", tx.post_class(F.col("title"), POS, NEG))
    derived = ops.label_tally(from_news, ["ticker"]).withColumn("source", F.lit("news_derived")).withColumn("priority", F.lit(9))
    return ops.first_source(social.unionByName(derived), "ticker")


# headlines are classed by the post rules here, so the edge set is the post one
POL_POST = polarity_cte(POS, NEG, tx.POST_EDGE)


@add("mood_source_fallback", with_(NEWS, NEWS_O, POL_POST, POSTS, TALLY, NEWS_MOOD, select="""
SELECT ticker, source, message_count, bullish, bearish, net_sentiment FROM allm WHERE message_count > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY pr, source) = 1"""))
def mood_source_fallback(spark, sf_dir):
    return chosen_mood(spark, sf_dir).select("ticker", "source", "message_count", "bullish", "bearish", "net_sentiment")


@add("page_mood", f"""
SELECT page_id, SIGN({_hits_sql('ws', POS)}::INT - {_hits_sql('ws', NEG)}::INT)::BIGINT AS label FROM (SELECT page_id, {_words_sql("REGEXP_REPLACE(html, '<[^>]+>', ' ', 'g')", tx.POST_EDGE)} AS ws FROM pages)""")
def page_mood(spark, sf_dir):
    """Class of each page's text after the tags are removed."""
    pages = data.table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.post_class(tx.strip_tags(F.col("html")), POS, NEG).alias("label"))


@add("most_engaged_posts", """
SELECT user_id, event_id, likes + reposts AS engagement, rank FROM (SELECT user_id, event_id, CAST(FLOOR(value) AS BIGINT) AS likes, event_id % 7 AS reposts, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CAST(FLOOR(value) AS BIGINT) + event_id % 7 DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def most_engaged_posts(spark, sf_dir):
    e = data.table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("post_id"), F.floor("value").cast("long").alias("likes"), (F.col("event_id") % 7).alias("reposts")
    )
    top = ops.most_engaged(e, "user_id", 5)
    return top.select("user_id", "event_id", (F.col("likes") + F.col("reposts")).alias("engagement"), "rank")


@add("daily_read_quota", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS reads, COUNT(*) >= 330 AS budget_exhausted, {rs('COUNT(*) * 0.005::DOUBLE', 4)} AS est_cost_usd FROM events GROUP BY 1""")
def daily_read_quota(spark, sf_dir):
    return ops.daily_quota(data.table(spark, sf_dir, "events"), 330, 0.005)


SENT = f"""s15 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, priority, news_id) AS rn FROM pol) WHERE rn <= 15),
sn AS (SELECT ticker, AVG(polarity) AS ap, COUNT(*) AS hc, SUM(CASE WHEN polarity > 0 THEN 1 ELSE 0 END)::BIGINT AS pc, SUM(CASE WHEN polarity < 0 THEN 1 ELSE 0 END)::BIGINT AS nc FROM s15 GROUP BY 1),
ss AS (SELECT ticker, net_sentiment FROM mood WHERE role = 'user' AND bullish + bearish > 0),
sj AS (SELECT COALESCE(sn.ticker, ss.ticker) AS ticker, ap, hc, pc, nc, net_sentiment FROM sn FULL JOIN ss ON sn.ticker = ss.ticker)"""


@add("sentiment_score", with_(NEWS, NEWS_O, POL, POSTS, TALLY, SENT, select=f"""
SELECT ticker, {r('ap')} AS avg_polarity, hc AS headline_count, pc AS positive_count, nc AS negative_count, net_sentiment, {r(clip('COALESCE(0.75::DOUBLE * (50 + ap * 35) + 0.25::DOUBLE * (50 + net_sentiment * 15), 50 + ap * 35, 50 + net_sentiment * 15)'))} AS sentiment FROM sj"""))
def sentiment_score(spark, sf_dir):
    """News and the users' social mood, blended per ticker."""
    heads = news(spark, sf_dir)
    social = moods(spark, sf_dir).where(F.col("role") == "user")
    return ops.sentiment(heads, social, POS, NEG)


EVID = f"""claims AS (SELECT ticker AS entity, provider AS source_name, CASE news_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'news' WHEN 2 THEN 'rumour' END AS source_type, title AS claim, CASE WHEN news_id % 3 <> 0 THEN 'u' END AS url, published_at, CASE WHEN news_id % 2 = 0 THEN 'news' ELSE 'options_chain' END AS data_type,
   (news_id % 31 - 15) / 10.0 AS pol, news_id FROM news_o),
ev0 AS (SELECT *, SUBSTRING(SHA1(entity || '|' || source_name || '|' || claim || '|' || COALESCE(url, 'None')), 1, 16) AS evidence_id, CASE WHEN published_at IS NULL THEN -1 ELSE GREATEST(0, FLOOR((epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 60))::BIGINT END AS age, CASE data_type WHEN 'news' THEN 720 ELSE 15 END AS lim FROM claims),
ev1 AS (SELECT *, (CASE WHEN published_at IS NULL THEN 40 WHEN age <= lim THEN 100 ELSE GREATEST(0, TRUNC(100 * (1 - (age - lim) / (3.0 * lim)))) END)::BIGINT AS fresh, CASE COALESCE(source_type, 'unknown') WHEN 'official' THEN 100 WHEN 'news' THEN 80 ELSE 50 END AS rel FROM ev0),
evid AS (SELECT * FROM ev1 QUALIFY ROW_NUMBER() OVER (PARTITION BY evidence_id ORDER BY news_id DESC) = 1)"""


def evidence(spark, sf_dir):
    n = F.col("news_id")
    claims = news(spark, sf_dir).select(
        F.col("ticker").alias("entity"),
        F.col("provider").alias("source_name"),
        F.when(n % 4 == 0, "official").when(n % 4 == 1, "news").when(n % 4 == 2, "rumour").alias("source_type"),
        F.col("title").alias("claim"),
        F.when(n % 3 != 0, "u").alias("url"),
        "published_at",
        F.when(n % 2 == 0, "news").otherwise("options_chain").alias("data_type"),
        F.col("title").alias("raw_excerpt"),
        ((n % 31 - 15) / 10.0).alias("polarity"),
        n.alias("seq"),
    )
    return ops.add_evidence(claims, as_of())


@add("evidence_log", with_(NEWS, NEWS_O, EVID, select=f"""
SELECT evidence_id, entity, source_name, COALESCE(source_type, 'unknown') AS source_type, claim, url, {r('GREATEST(-1, LEAST(1, pol))')} AS polarity, rel::BIGINT AS reliability_score, fresh AS freshness_score, age AS age_minutes FROM evid"""))
def evidence_log(spark, sf_dir):
    """One row per evidence key, the last write kept."""
    return ops.dedupe_evidence(evidence(spark, sf_dir)).select(
        "evidence_id", "entity", "source_name", "source_type", "claim", "url", "polarity", "reliability_score", "freshness_score", "age_minutes"
    )


@add("source_reliability", f"""
SELECT source, CASE CAST(REGEXP_EXTRACT(source, '(\\d+)', 1) AS INT) % 5 WHEN 0 THEN 100 WHEN 1 THEN 80 WHEN 2 THEN 70 WHEN 3 THEN 35 ELSE 50 END::BIGINT AS reliability, COUNT(*) AS documents FROM documents GROUP BY 1, 2""")
def source_reliability(spark, sf_dir):
    place = F.regexp_extract("source", r"(\d+)", 1).try_cast("int") % 5
    kind = F.when(place == 0, "official").when(place == 1, "news").when(place == 2, "aggregator").when(place == 3, "social").otherwise("blog")
    docs = data.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return docs.select("source", ops.reliability(kind).alias("reliability"), "documents")


@add("evidence_sides", with_(NEWS, NEWS_O, EVID, """es AS (SELECT *, CASE WHEN p > 0.1 THEN 'bull' WHEN p < -0.1 THEN 'bear' END AS sd FROM (SELECT *, GREATEST(-1, LEAST(1, pol)) AS p FROM ev1)),
es2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, sd ORDER BY news_id, evidence_id) AS rn FROM es)""", select=f"""
SELECT entity, {r('AVG(p)')} AS avg_polarity, COUNT(*) AS evidence_count, STRING_AGG(CASE WHEN sd = 'bull' AND rn <= 5 THEN evidence_id END, '; ' ORDER BY rn) AS key_bull_evidence, STRING_AGG(CASE WHEN sd = 'bear' AND rn <= 5 THEN evidence_id END, '; ' ORDER BY rn) AS key_bear_evidence FROM es2 GROUP BY entity"""))
def evidence_sides(spark, sf_dir):
    return ops.polarity_split(evidence(spark, sf_dir))


# one word per tag from the prose, so that thematic matches occur in the given tables
TAGS = {"semiconductors": ("the", "chip"), "ai": ("ation", "zz"), "cloud": ("er", "and"), "energy": ("opec", "le"), "pharma": ("die", "in")}
_drop = ", ".join(f"'{w}'" for w in (*ops.NAME_SUFFIXES, *ops.GENERIC_WORDS))
_kw = ", ".join(f"('{t}', '{k}')" for t, ks in TAGS.items() for k in ks)
IMPACT = f"""ab AS (SELECT ticker, LIST_FILTER(STRING_SPLIT_REGEX(TRIM(REGEXP_REPLACE(LOWER(company_name), '[^a-z0-9 ]', ' ', 'g'), ' '), ' +'), lambda t: LENGTH(t) > 2 AND NOT LIST_CONTAINS([{_drop}], t))[1] AS brand, strategy_tags FROM assets),
gw AS (SELECT *, LIST_FILTER(STRING_SPLIT_REGEX(LOWER(title), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS ws FROM gov_events),
tk AS (SELECT DISTINCT a.ticker, k.kw FROM (SELECT ticker, UNNEST(strategy_tags) AS tag FROM ab) a JOIN (VALUES {_kw}) k(tag, kw) ON k.tag = a.tag),
im AS (SELECT a.ticker, g.source, g.title, g.position, 0 AS tier, '' AS kw, g.kind, CASE WHEN g.kind IN ('fda', 'antitrust') THEN -0.3 ELSE -0.1 END::DOUBLE AS polarity FROM ab a JOIN gw g ON LIST_CONTAINS(g.ws, a.brand)
  UNION ALL SELECT t.ticker, g.source, g.title, g.position, 1, t.kw, g.kind, 0 FROM tk t JOIN gov_events g ON g.kind IN ('policy', 'trump_admin') AND CONTAINS(LOWER(g.title), t.kw)),
impacts AS (SELECT * FROM im QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, source, title ORDER BY position, tier, kw) = 1)"""


@add("policy_impacts", with_(GOV_EVENTS, ASSETS, IMPACT, select=f"""
SELECT ticker, source, position, kind, CASE WHEN tier = 0 THEN 'direct' ELSE 'thematic:' || kw END AS match_kind, {r('polarity')} AS polarity FROM impacts"""))
def policy_impacts(spark, sf_dir):
    links = ops.map_impacts(data.assets(spark, sf_dir), data.gov_events(spark, sf_dir), TAGS)
    return links.select("ticker", "source", "position", "kind", "match_kind", "polarity")


@add("top_events_per_kind", with_(GOV_EVENTS, select="""
SELECT kind, source, title, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY position) AS rank FROM gov_events) WHERE rank <= 2"""))
def top_events_per_kind(spark, sf_dir):
    return ops.top_per_kind(data.gov_events(spark, sf_dir)).select("kind", "source", "title", "rank")


@add("events_by_kind", with_(GOV_EVENTS, select="""
SELECT kind, COUNT(*) AS events, STRING_AGG(CASE WHEN rn <= 3 THEN title END, '; ' ORDER BY rn) AS titles FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY position) AS rn FROM gov_events) GROUP BY kind"""))
def events_by_kind(spark, sf_dir):
    return ops.listed_by(data.gov_events(spark, sf_dir), "kind", 3)
