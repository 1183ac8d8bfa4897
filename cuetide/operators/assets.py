"""Candidates enriched from their page, and the records made of them: assets, plans, what may be shown or started."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions import urls
from cuetide.operators import candidates as cd

# Codecs of pictures and of sound, containers of whole media, and a site's path of pictures alone.
VIDEO_CODEC = r"(?i)^(?:avc1|avc3|hvc1|hev1|vp8|vp9|av01|theora)(?:\.|$)"
STREAM_VIDEO_CODEC = r"(?i)^(?:avc1|avc3|hvc1|hev1|vp09|vp9|av01|dvhe|dvh1)(?:\.|$)"
MUXED_EXTENSIONS = ["mp4", "m4v", "mov", "webm", "mkv"]
FRAGMENT_EXTENSIONS = ["m4s", "ts", "cmfa", "cmfv"]
PLAYABLE_EXTENSIONS = [*urls.AUDIO_EXTENSIONS, "mp4", "webm"]
_SPLIT_HOST, _SPLIT_PATH = r"(^|\.)video\.twimg\.com$", r"(?i)/amplify_video/\d+/(?:vid|pl)/(?:avc1|h264|h265|hevc|vp9|av01)(?:/|$)"
_THUMB_HOST = r"(^|\.)pbs(-[a-z0-9-]+)?\.twimg\.com$"
_LIST_SITE = r"(?:^|\.)(?:bilibili(?:video)?\.com|bilivideo\.(?:com|cn))$"
BLOCKING = ["requires-signature-deciphering"]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _listed(codecs: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(codecs, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_direct_audio(kind: Column, ext: Column, ctype: Column, url: Column) -> Column:
    """A file of sound, not a playlist of one."""
    manifest = kind.isin("hls", "dash") | ext.isin(urls.MANIFEST_EXTENSIONS)
    return ~manifest & ((kind == "audio") | ctype.startswith("audio/") | ext.isin(urls.AUDIO_EXTENSIONS) | urls.extension(url).isin(urls.AUDIO_EXTENSIONS))


def is_split_video(url: Column) -> Column:
    """A site's URL of pictures whose sound is elsewhere."""
    return urls.host(url).rlike(_SPLIT_HOST) & urls.path(url).rlike(_SPLIT_PATH)


def is_direct_muxed(kind: Column, role: Column, ext: Column, ctype: Column, url: Column, codecs: Column) -> Column:
    """A file with pictures and sound: no playlist, no fragment, no pictures alone, no sound alone."""
    parts = _listed(codecs)
    pictures = (F.size(parts) > 0) & F.forall(parts, lambda c: c.rlike(VIDEO_CODEC))
    other = kind.isin("hls", "dash", "segment") | ext.isin(*urls.MANIFEST_EXTENSIONS, *FRAGMENT_EXTENSIONS) | is_split_video(url) | pictures
    whole = ext.isin(MUXED_EXTENSIONS) | ctype.startswith("video/") | role.isin("video", "media") | kind.isin("video", "media")
    return ~other & (role != "audio") & (kind != "audio") & whole


def is_variant_video_only(resolution: Column, codecs: Column, audio_only: Column, audio_group: Column) -> Column:
    """A stream that has a picture and only codecs of pictures, and names no sound."""
    parts = _listed(codecs)
    sound = F.coalesce(audio_only, F.lit(False)) | (F.coalesce(audio_group, F.lit("")) != "") | F.exists(parts, urls.codec_is_audio)
    return ~sound & (F.coalesce(resolution, F.lit("")) != "") & (F.size(parts) > 0) & F.forall(parts, lambda c: c.rlike(STREAM_VIDEO_CODEC))


def inherits_duration(page_duration: Column, page_has_media: Column, page_url: Column) -> Column:
    """Whether a candidate (url, kind, ext, source, content_type, size, duration, bandwidth, initiator) takes over its
    page's duration where it has none. Sound on its own does only if its size fits that duration or it is described."""
    u, kind, ext, ctype, source = F.col("url"), _text("kind"), _text("ext"), urls.content_type(F.col("content_type")), _text("source")
    positive = lambda c: F.coalesce(c > 0, F.lit(False))
    site = urls.host(u).rlike(_LIST_SITE) | urls.path(u).rlike("(?i)/upgcxcode/")
    own = positive(F.col("duration"))
    rate = F.col("size") * 8 / page_duration
    fits = positive(F.col("size")) & positive(page_duration) & F.coalesce(rate.between(cd.ACCEPTABLE_LOW, cd.PLAUSIBLE_HIGH), F.lit(False))
    described = source.isin("json-parse", "xhr-body") & positive(F.col("bandwidth"))
    trusted = own | (source == "media-element") | (source == "bilibili-playurl") | site | fits | described
    playable = ctype.startswith("audio/") | ctype.startswith("video/") | ext.isin(PLAYABLE_EXTENSIONS) | urls.extension(u).isin([x for x in PLAYABLE_EXTENSIONS if x not in ("flac", "wav")])
    start, here = _text("initiator"), F.coalesce(page_url, F.lit(""))
    same = (start == "") | (here == "") | (urls.page_identity(start) == urls.page_identity(here)) | (start.startswith("http") & here.startswith("http"))
    in_context = F.coalesce(page_has_media, F.lit(False)) & positive(page_duration) & playable & same
    return (
        F.when(urls.is_placeholder(u), False)
        .when(own | (source == "media-element") | kind.isin("hls", "dash") | (ext == "m4s") | site, True)
        .when(is_direct_audio(kind, ext, ctype, u) & ~trusted, False)
        .otherwise(in_context)
    )


def enrich(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates: tab, url, kind, ext, source, content_type, size, duration, video_width, video_height, bandwidth,
    initiator and more. pages: tab, page_url, page_title, page_duration, page_width, page_height, page_has_media, a row per
    tab. Adds what is derived of both: filename, origin, role, resolution, quality, relevance (0: as long as the page's
    medium) and score (lower: better to recognise). Tabs without a page row derive from the candidate alone."""
    u = F.col("url")
    both = candidates.join(pages.withColumnRenamed("tab", "_tab"), F.col("tab") == F.col("_tab"), "left").drop("_tab")
    typed = both.withColumns({"content_type": urls.content_type(F.col("content_type")), "size": F.coalesce("size", F.lit(0))})
    inherits = inherits_duration(F.col("page_duration"), F.col("page_has_media"), F.col("page_url"))
    shapes = ~urls.is_placeholder(u) & ((_text("source") == "media-element") | _text("kind").isin("hls", "dash"))
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    sized = typed.withColumns(
        {
            "duration": F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.when(inherits, F.col("page_duration"))),
            "video_width": F.coalesce(some("video_width"), F.when(shapes, some("page_width"))),
            "video_height": F.coalesce(some("video_height"), F.when(shapes, some("page_height"))),
            "filename": urls.filename(u),
            "origin": F.regexp_extract(F.lower(u), r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1),
        }
    )
    has_size = F.col("video_width").isNotNull() & F.col("video_height").isNotNull()
    named = sized.withColumns(
        {
            "role": urls.media_role(_text("kind"), u, F.col("content_type"), has_size),
            "resolution": F.when(has_size, F.concat_ws("x", F.col("video_width").cast("string"), F.col("video_height").cast("string"))).otherwise(""),
            "quality": F.struct(F.coalesce(F.col("video_height").cast("long"), urls.quality(u)["height"]).alias("height"), F.coalesce(F.col("bandwidth").cast("long"), urls.quality(u)["bandwidth"]).alias("bandwidth")),
        }
    )
    suitability = cd.audio_suitability(cd.audio_bitrate(urls.quality(u)["bandwidth"], F.col("bandwidth"), F.col("size"), F.col("duration")), _text("ext"), F.col("size"))
    return named.withColumns(
        {
            "relevance": cd.duration_relevance(F.col("duration"), F.col("page_duration")),
            "score": cd.recognition_score(F.col("role"), _text("kind"), _text("ext"), suitability, F.col("quality.height"), F.col("quality.bandwidth"), F.col("size")),
        }
    )


def media_number(url: Column) -> Column:
    """The number of a site's medium in the URL of its streams or of its picture; empty for others."""
    pattern = F.when(urls.host(url).rlike(_SPLIT_HOST), F.regexp_extract(urls.path(url), r"(?i)/amplify_video/(\d+)/", 1))
    return pattern.otherwise(F.regexp_extract(urls.path(url), r"(?i)/amplify_video_thumb/(\d+)/", 1))


def is_displayable(url: Column, variant_urls: Column, has_plan: Column, executable: Column, warnings: Column, page_media: Column) -> Column:
    """Groups to be shown: not another medium than the page's, and with a plan that can run and needs no deciphering;
    without a plan, not pictures alone. page_media: media_number of the page's medium, empty if unknown."""
    variants = F.coalesce(variant_urls, F.array().cast("array<string>"))
    ids = F.filter(F.transform(F.concat(F.array(url), variants), media_number), lambda x: x != "")
    foreign = (F.coalesce(page_media, F.lit("")) != "") & (F.size(ids) > 0) & ~F.array_contains(ids, page_media)
    alone = is_split_video(url) | ((F.size(variants) > 0) & F.forall(variants, is_split_video))
    blocked = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.isin(BLOCKING))
    runs = F.coalesce(executable, F.lit(True)) & ~blocked
    return ~foreign & F.when(F.coalesce(has_plan, F.lit(False)), runs).otherwise(~alone)


def without_secrets(df: DataFrame, variants: str | None = "variants") -> DataFrame:
    """What may leave for readers that are not trusted: without request headers, plans and trust, also within variants."""
    secret = ["request_headers", "request_context", "source_plan", "source_plan_trusted", "source_plan_used"]
    plain = df.drop(*secret)
    if variants and variants in plain.columns:
        kept = [f.name for f in plain.schema[variants].dataType.elementType.fields if f.name not in secret]
        plain = plain.withColumn(variants, F.transform(variants, lambda v: F.struct(*[v[n].alias(n) for n in kept])))
    return plain


def summary(df: DataFrame) -> DataFrame:
    """A variant as it is shown: what it is, where it is from, and how long, large and good it is."""
    return df.select("tab", "url", "kind", "role", "ext", "filename", "source", "size", "duration", "resolution", F.col("quality.bandwidth").alias("bandwidth"))


# Kinds and roles of assets; others become unknown.
ASSET_KINDS = ["audio", "video", "media", "hls", "dash", "segment", "subtitle"]
ASSET_ROLES = ["audio", "video", "media", "playlist", "segment"]


def asset() -> Column:
    """A candidate's canonical record: unknown words for what is not known, null for what is not positive."""
    one_of = lambda c, known: F.when(_text(c).isin(known), F.col(c)).otherwise("unknown")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.struct(
        _text("url").alias("url"), F.coalesce(F.nullif(_text("final_url"), F.lit("")), _text("url")).alias("final_url"),
        one_of("kind", ASSET_KINDS).alias("kind"), one_of("role", ASSET_ROLES).alias("role"), _listed(F.col("codecs")).alias("codecs"),
        positive("bandwidth").alias("bitrate"), positive("duration").alias("duration"),
        F.when((F.col("video_width") > 0) & (F.col("video_height") > 0), F.struct(F.col("video_width").alias("width"), F.col("video_height").alias("height"))).alias("dimensions"),
    )


def audio_plan(kind: Column, confidence: Column, executable: Column, input_type: Column) -> Column:
    """A plan of where sound is taken from: confidence within 0 and 1, executable unless told otherwise, and the strategy
    that its input needs."""
    form = F.coalesce(input_type, F.lit(""))
    strategy = F.when(form == "hls", "hls-playlist").when(form == "dash", "dash-manifest").when(form == "mse-fragments", "fmp4-fragments").when(kind == "muxed-media", "muxed-media-file").otherwise("direct-audio-file")
    return F.struct(
        F.coalesce(kind, F.lit("unknown")).alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"),
        F.coalesce(executable, F.lit(True)).alias("executable"), strategy.alias("strategy"), form.isin("hls", "dash", "mse-fragments").alias("requires_assembly"),
    )


#: Where a duration can be known from, and how strong that is.
DURATION_STRENGTH = {"media-element": 90, "player-json": 80, "manifest": 75, "network-header": 60, "url-token": 40, "page-meta": 35, "inferred": 20}


def _positive(c: Column) -> Column:
    return F.coalesce(F.when(c > 0, c), F.lit(0.0)).cast("double")


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def evidence_list(items: Column) -> Column:
    """An array of (source, strength, detail): empty text for what is not told, 0 for strengths that are not positive, without
    entries that say neither source nor detail. Null is an empty list."""
    clean = F.transform(items, lambda x: F.struct(_said(x["source"]).alias("source"), _positive(x["strength"]).alias("strength"), _said(x["detail"]).alias("detail")))
    kind = "array<struct<source:string,strength:double,detail:string>>"
    return F.coalesce(F.filter(clean, lambda x: (x["source"] != "") | (x["detail"] != "")), F.array().cast(kind)).cast(kind)


def warning_list(items: Column) -> Column:
    """An array of (code, message), each once, in order, without empty ones. Null is an empty list."""
    clean = F.transform(items, lambda x: F.struct(_said(x["code"]).alias("code"), _said(x["message"]).alias("message")))
    kind = "array<struct<code:string,message:string>>"
    return F.coalesce(F.array_distinct(F.filter(clean, lambda x: (x["code"] != "") | (x["message"] != ""))), F.array().cast(kind)).cast(kind)


def duration_evidence(source: Column, seconds: Column, strength: Column, detail: Column) -> Column:
    """Where a duration is known from: (source, seconds, strength, detail), null without a positive duration. A source that
    is not known is as strong as one that is inferred, unless a strength is given."""
    known = F.create_map(*[F.lit(x) for pair in DURATION_STRENGTH.items() for x in pair])
    named = F.coalesce(F.nullif(source, F.lit("")), F.lit("inferred"))
    own = F.coalesce(F.when(strength > 0, strength.cast("double")), F.element_at(known, named).cast("double"), F.lit(float(DURATION_STRENGTH["inferred"])))
    return F.when(seconds > 0, F.struct(named.alias("source"), seconds.cast("double").alias("seconds"), own.alias("strength"), _said(detail).alias("detail")))


def fragment_list(items: Column) -> Column:
    """An array of (url, name, segment_type, role, duration, start, end, offset, length), those with a URL, as they go into a
    plan: unknown roles, times that are not positive as 0, and byte ranges only where both numbers make one."""

    def clean(x: Column) -> Column:
        ranged = (x["offset"] >= 0) & (x["length"] > 0)
        role = F.when(x["role"].isin(ASSET_ROLES), x["role"]).otherwise("unknown")
        times = [_positive(x[n]).alias(n) for n in ("duration", "start", "end")]
        span = [F.when(ranged, F.floor(x[n]).cast("long")).alias(n) for n in ("offset", "length")]
        return F.struct(_said(x["url"]).alias("url"), _said(x["name"]).alias("name"), _said(x["segment_type"]).alias("segment_type"), role.alias("role"), *times, *span)

    return F.filter(F.transform(items, clean), lambda x: x["url"] != "")


def plan_relations(plans: DataFrame, known: DataFrame) -> DataFrame:
    """plans: plan, primary (an asset's id, or null), companions (array of ids). known: asset, the assets there are. (plan,
    asset, relation, pos, found): a plan's primary asset at 0 and its companions from 1, each asset once, the first place
    counting; found tells whether there is such an asset. Null ids relate to nothing."""
    all_ = F.concat(F.array("primary"), F.coalesce("companions", F.array().cast(plans.schema["companions"].dataType)))
    rows = plans.select("plan", F.posexplode(all_).alias("pos", "asset")).where("asset is not null")
    once = rows.groupBy("plan", "asset").agg(F.min("pos").cast("long").alias("pos"))
    there = known.select(F.col("asset").alias("_a")).distinct()
    both = once.join(there, F.col("asset") == F.col("_a"), "left")
    return both.select("plan", "asset", F.when(F.col("pos") == 0, "primary").otherwise("companion").alias("relation"), "pos", F.col("_a").isNotNull().alias("found"))


def execution(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df: a plan (audio_plan), trusted, url and more. (rows that can run, with input; rows that cannot, with reason): only
    plans that were made here, and not sent in, are trusted."""
    plan = F.col("plan")
    reason = F.when(~F.coalesce("trusted", F.lit(False)), "untrusted").when(~plan["executable"], "not executable").when(_text("url") == "", "no url")
    told = df.withColumn("reason", reason)
    return told.where("reason is null").drop("reason").withColumn("input", F.struct(plan["strategy"].alias("strategy"), F.col("url").alias("url"))), told.where("reason is not null")


def merged_profiles(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Profiles (id, ord, name, value): stored ones in place of defaults of their id, the first of an id counting, in
    order of the defaults, then of what is stored beyond them."""
    first = stored.groupBy("id").agg(F.min_by(F.struct("ord", "name", "value"), "ord").alias("s"))
    base = defaults.groupBy("id").agg(F.min_by(F.struct("ord", "name", "value"), "ord").alias("d"))
    both = base.join(first, "id", "full")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), F.col(f"d.{c}")).alias(c)
    return both.select("id", F.col("d.ord").isNull().alias("own"), F.coalesce("d.ord", "s.ord").alias("ord"), pick("name"), pick("value"))


def fragment_groups(df: DataFrame) -> DataFrame:
    """df: page, url, track, role, is_init, number, duration (null: unknown), ord. Fragments grouped by directory, track and
    container, and by directory alone where some have no role: (page, grp, by_track, role, fragments, reason); reason is
    null for groups that can be put together: an init fragment, two others at least in an unbroken sequence with a
    timeline, and one role."""
    u = F.col("url")
    folder = F.concat(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.regexp_replace(urls.path(u), "[^/]*$", ""))
    role = F.coalesce("role", F.lit("unknown"))
    rows = df.select("page", folder.alias("folder"), F.concat_ws(":", folder, F.coalesce(F.nullif(_text("track"), F.lit("")), role), urls.container_hint(u)).alias("key"), role.alias("role"), "is_init", "number", "duration", "ord")
    n = F.count_if(~F.col("is_init"))
    inits = F.count_if(F.col("is_init"))
    numbers = F.when(~F.col("is_init"), F.col("number"))
    known = F.count(numbers)
    unbroken = (known < n) | ((F.count_distinct(numbers) == n) & (F.max(numbers) - F.min(numbers) + 1 == n))
    some = F.collect_set(F.when(F.col("role") != "unknown", F.col("role")))
    one = F.when(F.size(some) == 1, some[0]).otherwise("unknown")
    reason = F.when(inits == 0, "no init").when(n < 2, "too few").when(F.count_if(F.col("duration") > 0) == 0, "no timeline").when(~one.isin("audio", "video"), "role").when(~unbroken, "gaps")
    told = [one.alias("role"), (n + inits).alias("fragments"), reason.alias("reason"), F.min("ord").alias("first")]
    by_track = rows.groupBy("page", F.col("key").alias("grp")).agg(*told).withColumn("by_track", F.lit(True))
    by_folder = rows.groupBy("page", F.col("folder").alias("grp")).agg(*told, inits.alias("i"), n.alias("m"), F.count_if(F.col("role") == "unknown").alias("u")).where("i > 0 and m > 0 and u > 0").drop("i", "m", "u").withColumn("by_track", F.lit(False))
    return by_track.unionByName(by_folder)


def best_fragments(df: DataFrame) -> DataFrame:
    """Of fragment_groups one per page: sound that can be put together, else the first that can, else the first."""
    rank = F.when(F.col("reason").isNull() & (F.col("role") == "audio"), 0).when(F.col("reason").isNull(), 1).otherwise(2)
    best = F.min_by(F.struct("grp", "role", "fragments", "reason"), F.struct(rank, ~F.col("by_track"), F.col("first")))
    return fragment_groups(df).groupBy("page").agg(best.alias("b")).select("page", "b.*")


def audio_companions(url: Column) -> Column:
    """Where the sound of a playlist of pictures may be, in order, distinct: its place with audio for video, tokens of
    tracks and formats, and a site's own places of sound."""
    p, base = urls.path(url), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    name = F.element_at(F.split(p, "/"), -1)
    folder = F.left(p, F.length(p) - F.length(name))
    list_ = name.rlike(r"(?i)\.m3u8$")
    token = r"(?i)([._-])f(\d+)([._-])v(\d+)(?=\.m3u8$|[._-])"
    form, track = F.regexp_extract(name, token, 2).try_cast("int"), F.regexp_extract(name, token, 4).try_cast("int")
    track = F.when(track > 0, track).otherwise(1)
    numbered = r"(?i)([._-])v(\d+)(?=\.m3u8$|[._-])"
    other = F.regexp_extract(name, numbered, 2).try_cast("int")
    other = F.when(other > 0, other).otherwise(1)
    pieces = lambda pattern: (F.regexp_extract(name, rf"(?i)^(.*?[._-])(?:{pattern})(?=\.m3u8$|[._-])", 1), F.regexp_extract(name, rf"(?i)^.*?[._-](?:{pattern})((?:\.m3u8$|[._-]).*)$", 1))
    head, tail = pieces(r"f\d+[._-]v\d+")
    joint = F.regexp_extract(name, token, 3)
    formed = lambda f: F.when(list_ & name.rlike(token) & (f > 0), F.concat(folder, head, F.lit("f"), f.cast("string"), joint, F.lit("a"), track.cast("string"), tail))
    head2, tail2 = pieces(r"v\d+")
    tracked = lambda t: F.when(list_ & name.rlike(numbered), F.concat(folder, head2, F.lit("a"), t.cast("string"), tail2))
    spoken = F.regexp_replace(name, r"(?i)([._-])video(?=\.m3u8$|[._-])", "$1audio")
    site = urls.host(url).rlike(_SPLIT_HOST) & p.rlike(r"(?i)^.*/pl/avc1/[^/]+/[^/]+\.m3u8$")
    placed = lambda rate: F.when(site, F.concat(F.regexp_extract(p, r"(?i)^(.*/pl/)avc1/", 1), F.lit(f"mp4a/{rate}/"), name))
    paths = F.array(
        F.when(p.rlike("(?i)/video/"), F.concat(F.regexp_extract(p, "(?i)^(.*?)/video/", 1), F.lit("/audio/"), F.regexp_extract(p, "(?i)^.*?/video/(.*)$", 1))),
        F.when(p.rlike(r"(?i)/video\.m3u8$"), F.regexp_replace(p, r"(?i)/video\.m3u8$", "/audio.m3u8")),
        formed(F.when(form > 1, form - 1)), formed(form), tracked(other), tracked(F.lit(1)),
        F.when(list_ & (spoken != name), F.concat(folder, spoken)), *[placed(r) for r in ("128000", "64000", "32000")],
    )
    return F.transform(F.array_distinct(F.filter(paths, lambda x: x.isNotNull() & (x != p))), lambda x: F.concat(base, x, rest))


def cache_entry_matches(page: Column, source: Column, entry_page: Column, entry_source: Column, meta_page: Column, meta_source: Column) -> Column:
    """Whether a cache entry belongs to a context; all are normalised URLs, empty where unknown. A side that is unknown
    does not reject, but the source must agree where the context has one, and the page where it has none."""
    differ = lambda a, b: (a != "") & (b != "") & (a != b)
    sound = ~differ(meta_page, page) & ~differ(meta_page, entry_page) & ~differ(meta_source, source) & ~differ(meta_source, entry_source)
    by_source = (entry_source == source) & ~differ(page, entry_page)
    return sound & F.when(source != "", by_source).otherwise((page != "") & (entry_page == page))


def same_source_segments(translated: DataFrame, sources: DataFrame) -> DataFrame:
    """translated: media_id, pos, key, s, e. sources: media_id, pos, key, s, e. Each translated row with the first source
    row of its key, or, where either has no key, of its times to the millisecond: (media_id, pos, source_pos), -1 if there
    is none. Two equal joins: by key, and by the milliseconds that a time is near to."""
    own = translated.withColumnRenamed("pos", "t_pos")
    keyed = sources.where(F.col("key").isNotNull()).groupBy("media_id", F.col("key").alias("_key")).agg(F.min("pos").alias("by_key"))
    found = own.join(keyed.withColumnRenamed("media_id", "_m"), (F.col("media_id") == F.col("_m")) & (F.col("key") == F.col("_key")), "left").drop("_m", "_key")
    slot = F.floor(F.col("s") * 1000)
    timed = sources.select(F.col("media_id").alias("_m"), F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    near = (F.abs(F.col("s") - F.col("_s")) < 0.001) & (F.abs(F.col("e") - F.col("_e")) < 0.001) & (F.col("key").isNull() | F.col("_key").isNull())
    pairs = found.join(timed, (F.col("media_id") == F.col("_m")) & (slot == F.col("_slot")) & near, "left")
    rows = pairs.groupBy("media_id", "t_pos").agg(F.min("by_key").alias("by_key"), F.min("_pos").alias("by_time"))
    return rows.select("media_id", F.col("t_pos").alias("pos"), F.coalesce(F.least("by_key", "by_time"), F.lit(-1)).alias("source_pos"))
