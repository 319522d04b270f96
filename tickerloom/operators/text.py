"""Feeds of titles and posts: merge, dedupe, relevance, mood and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import clamp, rnd_stable
from ..session import cut_lineage

# fixed values: reliability of a source type, and freshness limits in minutes
RELIABILITY = {
    "official": 100, "exchange": 90, "news": 80, "aggregator": 70, "search": 50, "social": 35, "rumor": 10, "unknown": 50,
}
FRESHNESS_MINUTES = {
    "intraday_price": 15,
    "daily_price": 1440,
    "options_chain": 15,
    "sec_filing": 1440,
    "macro": 64800,
    "news": 720,
    "social": 1440,
    "fundamentals": 172800,
}


def lookup(key: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def reliability(source_type: Column) -> Column:
    return lookup(source_type, RELIABILITY, 50)


def freshness(published_at: Column, as_of: Column, data_type: Column) -> tuple[Column, Column]:
    """(score, age in minutes): 100 inside the limit, linear to 0 at four times it."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(published_at)
    age = F.greatest(F.lit(0), F.floor(seconds / 60)).cast("long")
    limit = lookup(data_type, FRESHNESS_MINUTES, 1440)
    decayed = F.greatest(F.lit(0), (100 * (1 - (age - limit) / (3 * limit))).cast("int"))
    score = F.when(published_at.isNull(), 40).when(age <= limit, 100).otherwise(decayed)
    return score.cast("long"), F.when(published_at.isNull(), F.lit(-1)).otherwise(age).cast("long")


def dedupe_titles(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First item per normalised title in trust order; empty titles are dropped.

    Items may carry their ``title_key`` instead of the title, so that no text is shuffled.
    A minimum per key combines map-side, so a title copied a billion times costs
    one row per task, not one hot task.
    """
    keyed = items if "title_key" in items.columns else items.withColumn("title_key", tx.title_key(F.col("title")))
    rest = [c for c in items.columns if c not in (*by, *order, "title_key")]
    pick = F.min(F.struct(*order, *rest)).alias("_first")
    return keyed.where(F.col("title_key") != "").groupBy(*by, "title_key").agg(pick).select(*by, "title_key", "_first.*")


def merge_feeds(items: DataFrame, as_of: Column, max_age_hours: int = 24) -> DataFrame:
    """Per ticker: merged, deduped, no older than the limit, ranked newest first."""
    kept = dedupe_titles(items, ["ticker"], ["priority", "position"])
    kept = kept.where(recent_strict(F.col("published_at"), as_of, max_age_hours))
    return kept


def newest(items: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest items per key; the filter also runs before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("published_at"), "priority", "position")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def providers(items: DataFrame, by: str) -> DataFrame:
    """Providers that returned anything, as an ordered list (one entry per provider)."""
    return items.groupBy(by).agg(F.array_sort(F.collect_set("provider")).alias("providers"))


def recent_strict(published_at: Column, as_of: Column, hours: int) -> Column:
    return published_at >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def recent_lenient(published_at: Column, as_of: Column, days: int) -> Column:
    return published_at.isNull() | (published_at >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def text_runs(items: DataFrame, text: Column, least: int) -> DataFrame:
    """(news_id, kind, run): the distinct runs of each text, in one linear pass.

    Kind n: lower-case letters, digits and & at least ``least`` long, in which company
    words stand; kind s: upper-case letters and digits, of which symbols are made.
    """

    def runs(of: Column, pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(of, F.lit(pattern), F.lit(0)))

    kinds = F.array(
        F.struct(F.lit("n").alias("kind"), runs(F.lower(text), f"[a-z0-9&]{{{least},}}").alias("runs")),
        F.struct(F.lit("s").alias("kind"), runs(F.upper(text), "[A-Z0-9]+").alias("runs")),
    )
    return items.select("news_id", F.inline(kinds)).select("news_id", "kind", F.explode("runs").alias("run"))


def run_grams(runs: DataFrame, text: str, gram: int) -> DataFrame:
    """Each row with each distinct gram of its (short) text, by one look-ahead pass."""
    return runs.select("*", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1)))).alias("gram"))


def runs_with_words(vocabulary: DataFrame, words: DataFrame, gram: int = 4) -> DataFrame:
    """(run, token) pairs of which the run contains the token.

    Expects distinct ``run`` and distinct ``token`` of ``gram`` letters or more.  A token is
    looked up by the gram that the fewest runs hold, so a common gram costs nothing.
    """
    token_grams = run_grams(words.select("token"), "token", gram)
    pieces = run_grams(vocabulary.select("run"), "run", gram).join(token_grams.select("gram").distinct(), "gram", "left_semi")
    held = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = token_grams.join(held, "gram").groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return pieces.join(keys, "gram").where(F.contains("run", F.col("token"))).select("run", "token")


def attach_entities(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Pairs (item, ticker) where the text names the symbol or the company.

    Linear in the length of the texts, which are cut into runs once; the runs are written,
    as cutting costs far more than reading them.  A company word consists of letters,
    digits and &, so it stands within one run of these: the substring test is made once
    for each distinct run of the corpus, by the word's rarest 4-gram, and texts are joined
    by whole runs.  A symbol is looked up by the run of letters and digits of it that the
    fewest texts hold; if it has one run only, that is the test, else the texts of the
    candidates are fetched and searched.  A symbol without letter or digit names nothing.
    """
    text = F.concat_ws(" ", "title", "url")
    runs = cut_lineage(text_runs(items, text, 4))
    named = runs.where(F.col("kind") == "n").select("news_id", "run")
    spelt = runs.where(F.col("kind") == "s").select("news_id", "run")

    names = assets.select("ticker", F.explode(tx.company_tokens(F.col("company_name"))).alias("token"))
    pairs = runs_with_words(named.select("run").distinct(), names.select("token").distinct())
    by_name = named.join(pairs, "run").select("news_id", F.concat(F.lit("n:"), "token").alias("key"))

    whole = F.upper("ticker")
    parts = assets.select("ticker", F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit("[A-Z0-9]+"), F.lit(0)))).alias("run")).distinct()
    seen = spelt.join(parts.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    counted = parts.join(seen, "run", "left")
    key = counted.groupBy("ticker").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("_k")).where("_k.n > 0")
    keyed = key.select("ticker", F.col("_k.run").alias("run"), (whole == F.col("_k.run")).alias("sure"))
    spotted = spelt.join(keyed, "run").select("news_id", "ticker", "sure")
    unsure = spotted.where(~F.col("sure")).join(items.select("news_id", text.alias("_text")), "news_id")
    searched = unsure.where(tx.mentions_symbol(F.col("_text"), F.col("ticker")))
    by_symbol = spotted.where("sure").select("news_id", "ticker").unionByName(searched.select("news_id", "ticker"))
    hits = by_name.unionByName(by_symbol.select("news_id", F.concat(F.lit("s:"), "ticker").alias("key")))
    symbols = assets.select(F.concat(F.lit("s:"), "ticker").alias("key"), "ticker").where("ticker is not null").distinct()
    meant = names.select(F.concat(F.lit("n:"), "token").alias("key"), "ticker").unionByName(symbols)
    # dealt by item once: keys and tickers are made distinct within an item's rows
    return hits.repartition("news_id").distinct().join(meant, "key").select("news_id", "ticker").distinct()


def label_tally(posts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of labelled posts and the net mood; expects `label` of 1, -1 or 0."""
    bull = F.sum((F.col("label") > 0).cast("long"))
    bear = F.sum((F.col("label") < 0).cast("long"))
    out = posts.groupBy(*by).agg(F.count(F.lit(1)).alias("message_count"), bull.alias("bullish"), bear.alias("bearish"))
    net = F.try_divide((F.col("bullish") - F.col("bearish")).cast("double"), F.col("bullish") + F.col("bearish"))
    return out.withColumn("net_sentiment", F.coalesce(rnd_stable(net, 3), F.lit(0.0)))


def first_source(snapshots: DataFrame, by: str) -> DataFrame:
    """The best-ranked source that has messages; expects `priority`."""
    rest = [c for c in snapshots.columns if c not in (by, "priority")]
    live = snapshots.where(F.col("message_count") > 0)
    return live.groupBy(by).agg(F.min(F.struct("priority", *rest)).alias("_s")).select(by, "_s.*").drop("priority")


def most_engaged(posts: DataFrame, by: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.col("likes") + F.col("reposts")), "post_id")
    return posts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def daily_quota(reads: DataFrame, budget: int, cost_per_read: float) -> DataFrame:
    """Reads per UTC day, whether the budget is used up, and the cost."""
    out = reads.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("reads"))
    spent = F.lit(False) if budget <= 0 else F.col("reads") >= budget
    return out.withColumn("budget_exhausted", spent).withColumn(
        "est_cost_usd", rnd_stable(F.col("reads") * cost_per_read, 4)
    )


def sentiment(headlines: DataFrame, social: DataFrame | None, positive=tx.NEWS_POSITIVE, negative=tx.NEWS_NEGATIVE) -> DataFrame:
    """Sentiment score per ticker from its newest 15 headlines and capped social mood."""
    scored = newest(headlines, "ticker", 15).withColumn("polarity", tx.polarity(F.col("title"), positive, negative))
    news = scored.groupBy("ticker").agg(
        F.avg("polarity").alias("avg_polarity"),
        F.count(F.lit(1)).alias("headline_count"),
        F.sum((F.col("polarity") > 0).cast("long")).alias("positive_count"),
        F.sum((F.col("polarity") < 0).cast("long")).alias("negative_count"),
    )
    if social is None:
        news = news.withColumn("net_sentiment", F.lit(None).cast("double"))
    else:
        mood = social.where(F.col("bullish") + F.col("bearish") > 0).select("ticker", "net_sentiment")
        news = news.join(mood, "ticker", "full_outer")
    from_news = 50 + F.col("avg_polarity") * 35
    from_social = 50 + clamp(F.col("net_sentiment"), -1.0, 1.0) * 15
    score = clamp(F.coalesce(0.75 * from_news + 0.25 * from_social, from_news, from_social))
    return news.withColumn("sentiment", score)


def evidence_id(entity: Column, source: Column, claim: Column, url: Column) -> Column:
    """Content key; a missing url reads as the text None."""
    text = F.concat_ws("|", entity, source, claim, F.coalesce(url, F.lit("None")))
    return F.substring(F.sha1(text), 1, 16)


def add_evidence(claims: DataFrame, as_of: Column) -> DataFrame:
    """Evidence rows with key, rank and freshness; expects the claim columns."""
    source = F.coalesce("source_name", F.lit("unknown_source"))
    kind = F.coalesce("source_type", F.lit("unknown"))
    claim = F.coalesce("claim", F.lit(""))
    score, age = freshness(F.col("published_at"), as_of, F.col("data_type"))
    return claims.select(
        evidence_id(F.col("entity"), source, claim, F.col("url")).alias("evidence_id"),
        "entity",
        source.alias("source_name"),
        kind.alias("source_type"),
        "url",
        "published_at",
        claim.alias("claim"),
        F.substring("raw_excerpt", 1, 2000).alias("raw_excerpt"),
        clamp(F.col("polarity"), -1.0, 1.0).alias("polarity"),
        reliability(kind).alias("reliability_score"),
        score.alias("freshness_score"),
        age.alias("age_minutes"),
        "seq",
    )


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """One row per key; the last write wins, combined map-side."""
    rest = [c for c in evidence.columns if c not in ("evidence_id", "seq")]
    return (
        evidence.groupBy("evidence_id").agg(F.max(F.struct("seq", *rest)).alias("_e")).select("evidence_id", "_e.*")
    )


def polarity_split(evidence: DataFrame, n: int = 5) -> DataFrame:
    """Per entity: the first n clearly positive and negative keys, and the mean.

    Only ranked rows are collected, so each list has at most n entries.
    """
    side = F.when(F.col("polarity") > 0.1, "bull").when(F.col("polarity") < -0.1, "bear")
    w = Window.partitionBy("entity", "_side").orderBy("seq", "evidence_id")
    picked = (
        evidence.withColumn("_side", side)
        .where(F.col("_side").isNotNull())
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= n)
    )
    entry = F.struct("_r", "evidence_id")
    lists = picked.groupBy("entity").agg(
        *[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == s, entry))), lambda e: e["evidence_id"]).alias(
                f"key_{s}_evidence"
            )
            for s in ("bull", "bear")
        ]
    )
    means = evidence.groupBy("entity").agg(
        F.avg("polarity").alias("avg_polarity"), F.count(F.lit(1)).alias("evidence_count")
    )
    return means.join(lists, "entity", "left")


# fixed values: words dropped from a company name before it is matched
NAME_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "lp", "ltd", "limited", "plc", "holdings",
    "group", "trust", "the", "class", "common", "stock", "etf", "fund",
)
GENERIC_WORDS = (
    "medical", "systems", "system", "digital", "works", "media", "technologies", "technology", "solutions",
    "services", "global", "international", "national", "american", "health", "healthcare", "pharma",
    "pharmaceuticals", "labs", "laboratories", "industries", "partners", "capital", "financial", "energy", "motors",
    "products", "brands", "enterprises", "networks", "data",
)
# fixed values: policy keywords per strategy tag
TAG_KEYWORDS = {
    "semiconductors": ("semiconductor", "chip", "export control", "chips act"),
    "ai": ("artificial intelligence", "ai regulation", "ai safety", "ai export"),
    "technology": ("big tech", "antitrust", "app store", "section 230", "data privacy"),
    "ev": ("electric vehicle", "ev tax credit", "ev subsidy", "auto tariff"),
    "cloud": ("cloud", "federal cloud", "data center"),
    "small_caps": ("small business", "regional bank"),
    "energy": ("crude", "opec", "energy policy", "drilling"),
    "healthcare": ("fda", "drug pricing", "medicare", "medicaid"),
    "pharma": ("fda", "drug pricing", "clinical"),
    "biotech": ("fda", "clinical trial", "drug approval"),
}


def brand_token(company_name: Column) -> Column:
    """First distinctive word of the name, NULL when there is none."""
    cleaned = F.split(F.trim(F.regexp_replace(F.lower(company_name), "[^a-z0-9 ]", " ")), " +")
    drop = F.array(*[F.lit(w) for w in (*NAME_SUFFIXES, *GENERIC_WORDS)])
    return F.try_element_at(F.filter(cleaned, lambda t: (F.length(t) > 2) & ~F.array_contains(drop, t)), F.lit(1))


def impact_links(assets: DataFrame, events: DataFrame, tag_keywords: dict[str, tuple[str, ...]] = TAG_KEYWORDS) -> tuple[DataFrame, DataFrame]:
    """The links of policy events in factors: events with what they touch, and names with how they are touched.

    Events of equal source and title are one group (``event_tag``, 128 bits), so a title
    repeated a billion times is matched once; no text leaves the stage that reads it.  A
    name is touched through its brand word, or through the set of keywords of its tags
    (``theme``), and there are far fewer such sets than names.  The first table has
    (event_tag, source, touch, position, tier, kw, kind, polarity), one row for each group and
    touch, the second (touch, ticker).
    """
    tag = F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce("source", F.lit("\u0002")), F.coalesce("title", F.lit("\u0002")))))
    first = F.struct("position", "kind")
    broad = F.col("kind").isin("policy", "trump_admin")
    keyed = events.withColumn("event_tag", tag)
    # smallest positions of all events and of the policy ones: a group needs no other event
    firsts = keyed.groupBy("event_tag").agg(F.min(first).alias("any"), F.min(F.when(broad, first)).alias("broad"), F.min("source").alias("source"))
    low = F.col("_low")
    keywords = sorted({k for words in tag_keywords.values() for k in words})
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]))

    brands = assets.select("ticker", brand_token(F.col("company_name")).alias("word")).where("word is not null")
    spoken = keyed.select("event_tag", F.explode(tx.tokens(F.col("title"))).alias("word"))
    direct = spoken.join(brands.select("word").distinct(), "word", "left_semi").distinct().join(firsts, "event_tag")
    adverse = F.when(F.col("any.kind").isin("fda", "antitrust"), -0.3).otherwise(-0.1)
    direct = direct.select(
        "event_tag", "source", F.concat(F.lit("word:"), "word").alias("touch"), "any.position", F.lit(0).alias("tier"), F.lit("").alias("kw"), "any.kind", adverse.alias("polarity")
    )

    tag_map = F.create_map(*[x for t, ks in tag_keywords.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
    tags = F.transform(F.array_compact(F.concat(F.coalesce("strategy_tags", F.array().cast("array<string>")), F.array("sector", "industry"))), F.lower)
    wanted = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(tags, lambda t: F.try_element_at(tag_map, t))))))
    themed = assets.select("ticker", wanted.alias("wanted")).where(F.size("wanted") > 0)
    themed = themed.select("ticker", "wanted", F.concat(F.lit("theme:"), F.array_join("wanted", "|")).alias("touch"))
    themes = themed.select("touch", F.explode("wanted").alias("kw")).distinct()
    # a column of its own: within the generator each keyword would lower the whole text again
    lowered = keyed.where(broad).select("event_tag", F.lower("title").alias("_low"))
    found = lowered.select("event_tag", F.explode(present).alias("kw")).distinct()
    by_theme = found.join(themes, "kw").groupBy("event_tag", "touch").agg(F.min("kw").alias("kw")).join(firsts, "event_tag")
    by_theme = by_theme.select("event_tag", "source", "touch", "broad.position", F.lit(1).alias("tier"), "kw", "broad.kind", F.lit(0.0).alias("polarity"))

    members = brands.select(F.concat(F.lit("word:"), "word").alias("touch"), "ticker").unionByName(themed.select("touch", "ticker"))
    return direct.unionByName(by_theme), members


def map_impacts(assets: DataFrame, events: DataFrame, tag_keywords: dict[str, tuple[str, ...]] = TAG_KEYWORDS, salts: int = 32) -> DataFrame:
    """Policy events linked to the names they touch.

    Direct: the brand word is a word of the title.  Thematic: a policy title holds a
    keyword of one of the asset's tags.  Per asset and (source, title) the first matching
    event counts, and within it the direct tier, then the first keyword.  The factors are
    expanded here only: one theme may hold most events, so they are dealt over ``salts``
    copies of the names.
    """
    touches, members = impact_links(assets, events, tag_keywords)
    salt = F.pmod(F.xxhash64("event_tag"), F.lit(salts)).cast("int")
    dealt = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = touches.withColumn("salt", salt).join(dealt, ["touch", "salt"])
    match = F.min(F.struct("position", "tier", "kw", "kind", "polarity", "source")).alias("_m")
    out = both.groupBy("ticker", "event_tag").agg(match)
    kind = F.when(F.col("_m.tier") == 0, "direct").otherwise(F.concat(F.lit("thematic:"), F.col("_m.kw")))
    return out.select("ticker", "_m.source", "_m.position", "_m.kind", kind.alias("match_kind"), "_m.polarity")


def top_per_kind(events: DataFrame, n: int = 2) -> DataFrame:
    w = Window.partitionBy("kind").orderBy("position")
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def count_by(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def listed_by(events: DataFrame, by: str, n: int) -> DataFrame:
    """Count per group and its first n titles; only ranked rows are collected."""
    w = Window.partitionBy(by).orderBy("position")
    ranked = events.select(by, "title", "position", F.row_number().over(w).alias("_r")).where(F.col("_r") <= n)
    entry = F.struct("_r", "title")
    titles = ranked.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["title"]).alias("titles")
    )
    return count_by(events, by).join(titles, by)
