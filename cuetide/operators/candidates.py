"""Media candidates: scores, groups and choices. A lower score is better for speech recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions import urls
from cuetide.operators.retention import source_rank
from cuetide.params import P

# Bit rates of audio, in bits a second, between which it is good or still good.
ACCEPTABLE_LOW, IDEAL_LOW, IDEAL_HIGH, ACCEPTABLE_HIGH, PLAUSIBLE_HIGH = 48_000, 96_000, 160_000, 320_000, 768_000


# A site's track numbers, the best for speech first.
SITE_TRACKS = ["30232", "30216", "30280"]


def site_track_preference(track: Column) -> Column:
    """The place of a track number among SITE_TRACKS; others come after them."""
    place = F.array_position(F.array(*[F.lit(t) for t in SITE_TRACKS]), track)
    return F.when(place > 0, place - 1).otherwise(len(SITE_TRACKS))


def bitrate_penalty(rate: Column) -> Column:
    return (
        F.when(rate < ACCEPTABLE_LOW, 8 + (ACCEPTABLE_LOW - rate) / ACCEPTABLE_LOW)
        .when(rate < IDEAL_LOW, 1 + (IDEAL_LOW - rate) / IDEAL_LOW)
        .when(rate <= IDEAL_HIGH, F.lit(0.0))
        .when(rate <= ACCEPTABLE_HIGH, 1 + (rate - IDEAL_HIGH) / IDEAL_HIGH)
        .otherwise(5 + F.least((rate - ACCEPTABLE_HIGH) / ACCEPTABLE_HIGH, F.lit(12.0)))
    )


def container_penalty(ext: Column) -> Column:
    """Extensions, and what they cost."""
    return F.when(ext.isin("flac", "wav", "aiff", "aif", "alac"), 6).when(ext.isin("aac", "m4a", "mp3", "mp4", "m4s", "oga", "ogg", "opus", "weba"), 0).otherwise(1)


def audio_bitrate(url_rate: Column, explicit: Column, size: Column, duration: Column) -> Column:
    """Bits a second: of the URL, as stated, or from size and duration; 0 if unknown."""
    derived = F.when((size > 0) & (duration > 0), size * 8 / duration)
    return F.coalesce(F.when(url_rate > 0, url_rate.cast("double")), F.when(explicit > 0, explicit.cast("double")), derived, F.lit(0.0))


def audio_suitability(rate: Column, ext: Column, size: Column) -> Column:
    unknown = 2 + F.when(size > 0, F.least(size / (1 << 20) / 50, F.lit(6.0))).otherwise(0.0)
    return F.when(rate > 0, bitrate_penalty(rate)).otherwise(unknown) + container_penalty(ext)


def recognition_score(role: Column, kind: Column, ext: Column, suitability: Column, height: Column, bandwidth: Column, size: Column) -> Column:
    picture = F.coalesce(height, F.lit(0)) / 1000 + F.coalesce(bandwidth, F.lit(0)) / 10_000_000
    fragment = (ext == "m4s") & (kind != "audio")
    return (
        F.when(fragment, 30 + F.least(size / (1 << 20), F.lit(60.0))).when(role == "audio", suitability).when(kind == "hls", 10 + picture)
        .when(kind == "dash", 20 + picture).when(role == "video", 40 + picture).otherwise(F.lit(50.0))
    )


def duration_relevance(duration: Column, target: Column) -> Column:
    """How far a candidate's duration is from the page's: 0 near, 4 unknown, 8 and more off; 0 if the page has none."""
    drift = F.abs(duration - target)
    near = F.greatest(F.lit(2.0), F.least(F.lit(12.0), target * 0.03))
    known = F.when(F.coalesce(duration, F.lit(0.0)) <= 0, 4.0).when(drift <= near, 0.0).otherwise(8 + F.least(drift / target, F.lit(8.0)))
    return F.when(F.coalesce(target, F.lit(0.0)) <= 0, 0.0).otherwise(known)


def retention_score(role: Column, kind: Column, ext: Column, type_: Column, source: Column) -> Column:
    """Points of a candidate's role, kind, source and container."""
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    body = source.isin("json-parse", "fetch-body", "xhr-body")
    return (
        points((role == "audio") | (kind == "audio") | type_.startswith("audio/"), 90)
        + points(kind.isin("hls", "dash") | ext.isin(urls.MANIFEST_EXTENSIONS), 80)
        + F.when(body, 16).when(source.isin("response", "media-element"), 10).otherwise(0)
        - points((role == "video") | type_.startswith("video/"), 8)
        - points((kind == "segment") | ext.isin("m4s", "ts", "cmfa", "cmfv"), 32)
    )


def retain(df: DataFrame, score: Column, most: int = P.candidates_kept) -> DataFrame:
    """The best candidates of each tab: by score, then the newest, then by place."""
    order = Window.partitionBy("tab").orderBy(score.desc(), F.col("seen_at").desc(), F.col("seq"))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def similarity_key(page: Column, duration: Column, role: Column, kind: Column, url: Column) -> Column:
    """By which candidates are variants of one medium: page and duration to five seconds, page and family, or URL."""
    family = urls.family_path(url)
    sound = F.regexp_replace(family, r"(?i)\.(?:aac|flac|m4a|mp3|mp4|oga|ogg|opus|wav|weba)$", ".{audio}".replace("{", r"\{").replace("}", r"\}"))
    five = (F.floor(duration / 5 + 0.5) * 5).cast("string")
    same = role.isin("audio", "video", "playlist", "media") | kind.isin("audio", "video", "hls", "dash", "media")
    timed = F.when((duration > 0) & (page != ""), five)
    return F.coalesce(
        F.when(timed.isNotNull() & same, F.concat_ws(":", F.lit("page-duration"), page, timed)),
        F.when((page != "") & (family != ""), F.concat_ws(":", F.lit("page"), page, F.when((role == "audio") | (kind == "audio"), sound).otherwise(family))),
        F.concat_ws(":", kind, urls.canonical_url(url)),
    )


def group(df: DataFrame) -> DataFrame:
    """df: tab, key, seq, relevance, score, source, size, role, seen_at. A row per (tab, key): the chosen variant, how many
    others there are, roles counted, and the group's rank in the tab."""
    known = F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(float("inf")))
    order = F.struct(F.col("relevance"), F.col("score"), -source_rank(F.col("source")), known, F.col("seq"))
    groups = df.groupBy("tab", "key").agg(
        F.min_by(F.struct("seq", "relevance", "score", "seen_at"), order).alias("best"),
        (F.count(F.lit(1)) - 1).alias("hidden"),
        F.count_if(F.col("role") == "audio").alias("audio"),
        F.count_if(F.col("role") == "video").alias("video"),
        F.count_if(F.col("role") == "playlist").alias("manifests"),
    )
    place = Window.partitionBy("tab").orderBy("best.relevance", "best.score", F.col("best.seen_at").desc(), "best.seq")
    return groups.withColumn("rank", F.row_number().over(place)).select("tab", "key", "best.seq", "hidden", "audio", "video", "manifests", "rank")


def choose_variant(df: DataFrame, keys: list[str]) -> DataFrame:
    """df: audio_only, audio_rank, bandwidth, pixels, ord. One HLS variant: sound alone first, then by evidence of sound,
    then the lowest known bandwidth, then the fewest pixels."""
    known = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(9007199254740991))
    order = F.struct(~F.col("audio_only"), F.col("audio_rank"), known("bandwidth"), known("pixels"), F.col("ord"))
    return df.groupBy(*keys).agg(F.min_by("ord", order).alias("ord"))


def choose_near_bandwidth(df: DataFrame, keys: list[str], target: int = 128_000) -> DataFrame:
    """The variant nearest to a bandwidth; an unknown one counts as being there."""
    distance = F.abs(F.when(F.col("bandwidth") > 0, F.col("bandwidth")).otherwise(F.lit(target)) - target)
    return df.groupBy(*keys).agg(F.min_by("ord", F.struct(distance, F.col("ord"))).alias("ord"))


def choose_plan(plans: DataFrame) -> DataFrame:
    """plans: media_id, kind, executable, confidence, ord. One per media: a site's own, executable direct audio, HLS by
    confidence, then the first executable of dash, fragments, direct, muxed, then whatever comes first."""
    kind, runs = F.col("kind"), F.col("executable")
    rank = F.when(kind == "site", 0).when((kind == "direct") & runs, 1).when(kind == "hls", 2).when(runs & kind.isin("dash", "fragments", "direct", "muxed"), 3).otherwise(4)
    step = F.when(kind == "dash", 0).when(kind == "fragments", 1).when(kind == "direct", 2).when(kind == "muxed", 3).otherwise(4)
    order = F.struct(rank, F.when(kind == "hls", -F.col("confidence")).otherwise(F.lit(0.0)), step, F.col("ord"))
    return plans.groupBy("media_id").agg(F.min_by(F.struct("kind", "ord"), order).alias("p")).select("media_id", "p.kind", "p.ord")


def fingerprint(url: Column, kind: Column, ext: Column, role: Column, content_type: Column, picture: Column) -> Column:
    """What candidates of one medium share: a site's own identity and track; the exact URL of manifests; for sound and
    pictures the canonical URL, and the track if the file is a segment; else kind and canonical URL. picture: whether its
    size is known."""
    typed = urls.content_type(content_type)
    sound, shown = (kind == "audio") | typed.startswith("audio/"), (kind == "video") | typed.startswith("video/") | picture
    track = urls.site_track(url)
    spoken = urls.filename(url).rlike(r"(?i)(?:^|-)302(?:16|32|80)(?=\.m4s$)") | urls.path(url).rlike("(?i)/audio/")
    site = F.when(track.isNotNull(), F.concat(F.lit("track:"), track)).when(spoken | sound, "role:audio").when(shown, "role:video").otherwise(F.concat(F.lit("role:"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("media"))))
    number = F.regexp_extract(urls.filename(url), r"(?i)(?:^|[-_])(\d{4,6})(?=\.(?:m4s|mp4)$)", 1)
    part = F.when(number != "", F.concat(F.lit(":track:"), number)).when((role == "audio") | sound, ":role:audio").when((role == "video") | shown, ":role:video").otherwise("")
    part = F.when(urls.filename(url).rlike(r"(?i)\.(?:m4s|mp4)$"), part).otherwise("")
    whole = lambda c: F.coalesce(F.nullif(c, F.lit("")), url, F.lit(""))
    manifest = kind.isin("hls", "dash") | ext.isin(urls.MANIFEST_EXTENSIONS)
    same = role.isin("audio", "video", "playlist", "media") | kind.isin("audio", "video", "hls", "dash", "media")
    return urls.let(
        urls.site_medium(url),
        lambda medium: F.when(medium.isNotNull(), F.concat_ws(":", F.lit("site"), medium, site))
        .when(F.coalesce(manifest, F.lit(False)), F.concat_ws(":", kind, whole(urls.exact_url(url))))
        .when(F.coalesce(same, F.lit(False)), F.concat(F.lit("media:"), urls.canonical_url(url), part))
        .otherwise(F.concat_ws(":", kind, whole(urls.canonical_url(url)))),
    )


def same_target(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted: tab, id, url, kind, ext, role, content_type, picture. known: these and ord. For each wanted row the first known
    one of its tab (by ord, then id) that has its URL, its canonical URL or its fingerprint: (tab, id, target, by), by
    naming the closest of the three ways in which that one matches. Rows without a URL match nothing, and rows without a
    match have no row.

    Three lookups in one equality join: each row has up to three keys, known ones are brought down to the first of each
    key before, so a key costs one row there however many candidates share it."""
    u = F.col("url")
    fp = fingerprint(u, *[F.coalesce(F.col(c), F.lit("")) for c in ("kind", "ext", "role", "content_type")], F.coalesce("picture", F.lit(False)))
    ways = [("url", u), ("canonical", urls.canonical_url(u)), ("fingerprint", fp)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), c.alias("key")) for i, (_, c) in enumerate(ways)]))
    keyed = lambda df, *more: df.where(F.coalesce("url", F.lit("")) != "").select("tab", "id", *more, keys.alias("x")).select("tab", "id", *more, "x.way", "x.key").where("key <> ''")
    first = keyed(known, "ord").groupBy(F.col("tab").alias("_t"), F.col("way").alias("_w"), F.col("key").alias("_k")).agg(F.min(F.struct("ord", "id")).alias("first"))
    pairs = keyed(wanted).join(first, (F.col("tab") == F.col("_t")) & (F.col("way") == F.col("_w")) & (F.col("key") == F.col("_k")))
    best = pairs.groupBy("tab", "id").agg(F.min(F.struct("first", "way")).alias("b"))
    return best.select("tab", "id", F.col("b.first.id").alias("target"), F.element_at(F.array(*[F.lit(n) for n, _ in ways]), F.col("b.way") + 1).alias("by"))
