"""Streaming manifests: HLS playlists and DASH descriptions. A manifest is a row (url, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.times import iso_duration
from cuetide.functions.urls import codecs_are_audio, resolve
from cuetide.session import ship


def attributes(text: Column) -> Column:
    """NAME=value and NAME="value" pairs as a map; of equal names the last counts."""
    pairs = F.regexp_extract_all(text, F.lit(r'([A-Za-z0-9\-]+=(?:"[^"]*"|[^,"]*))'), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.upper(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"), F.regexp_replace(F.regexp_extract(p, "^[^=]*=(.*)$", 1), '^"|"$', "").alias("value")))
    return F.map_from_entries(entries)


def _lines(df: DataFrame) -> DataFrame:
    rows = df.select("url", F.posexplode(F.split("body", "\r?\n")).alias("ord", "line"))
    return rows.select("url", F.col("ord").cast("long").alias("ord"), F.trim("line").alias("line")).where("line <> ''")


def hls_variants(df: DataFrame) -> DataFrame:
    """(url, ord, uri, kind, bandwidth, resolution, codecs, audio_group, audio_only): renditions of sound and streams, each
    with the next line that is a URI."""
    rows = _lines(df)
    ahead = Window.partitionBy("url").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    uri = F.first(F.when(~F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(ahead)
    marked = rows.withColumns({"uri": uri, "kind": F.when(F.col("line").startswith("#EXT-X-STREAM-INF:"), "stream").when(F.col("line").startswith("#EXT-X-MEDIA:"), "media")}).where("kind is not null")
    read = marked.withColumn("a", attributes(F.regexp_replace("line", "^[^:]*:", "")))
    get = lambda name: F.coalesce(F.element_at("a", name), F.lit(""))
    sound = (F.col("kind") == "media") & (F.upper(get("TYPE")) == "AUDIO") & (get("URI") != "")
    stream = (F.col("kind") == "stream") & F.col("uri").isNotNull()
    alone = F.when(F.col("kind") == "media", True).otherwise((get("RESOLUTION") == "") & (get("VIDEO") == "") & codecs_are_audio(get("CODECS")))
    rate = F.coalesce(get("BANDWIDTH").try_cast("long"), get("AVERAGE-BANDWIDTH").try_cast("long"), F.lit(0).cast("long"))
    return read.where(sound | stream).select("url", "ord", F.when(F.col("kind") == "media", get("URI")).otherwise(F.col("uri")).alias("uri"), "kind", rate.alias("bandwidth"), get("RESOLUTION").alias("resolution"), get("CODECS").alias("codecs"), get("AUDIO").alias("audio_group"), alone.alias("audio_only"))


def hls_segments(df: DataFrame) -> DataFrame:
    """(url, idx, uri, s, e, key_uri, map_uri, offset, length, discontinuity, gap): media segments with the key and map in
    force, times as running sums, and byte ranges, of which one without an offset follows the one before in its URL."""
    rows = _lines(df)
    upto = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lambda tag, value: F.when(F.col("line").startswith(tag), value)
    a = attributes(F.regexp_replace("line", "^[^:]*:", ""))
    key = tagged("#EXT-X-KEY:", F.when(F.upper(F.element_at(a, "METHOD")) == "AES-128", F.coalesce(F.element_at(a, "URI"), F.lit(""))).otherwise(""))
    seconds = tagged("#EXTINF:", F.coalesce(F.regexp_extract("line", r"^#EXTINF:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0)))
    is_uri = ~F.col("line").startswith("#")
    block = F.sum(F.when(is_uri, 1).otherwise(0)).over(Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumns({"_block": F.coalesce(block, F.lit(0)), "_key": F.last(key, ignorenulls=True).over(upto), "_map": F.last(tagged("#EXT-X-MAP:", F.element_at(a, "URI")), ignorenulls=True).over(upto), "_sec": seconds, "_range": tagged("#EXT-X-BYTERANGE:", F.regexp_replace("line", "^[^:]*:", "")), "_disc": F.col("line") == "#EXT-X-DISCONTINUITY", "_gap": F.col("line") == "#EXT-X-GAP", "_uri": F.when(is_uri, F.col("line"))})
    one = marked.groupBy("url", "_block").agg(F.max("_uri").alias("uri"), F.coalesce(F.max_by("_sec", F.when(F.col("_sec").isNotNull(), F.col("ord"))), F.lit(0.0)).alias("seconds"), F.max_by("_key", "ord").alias("key_uri"), F.max_by("_map", "ord").alias("map_uri"), F.max("_range").alias("range"), F.max("_disc").alias("discontinuity"), F.max("_gap").alias("gap")).where("uri is not null")
    order = Window.partitionBy("url").orderBy("_block")
    end = F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, 0))
    length = F.regexp_extract("range", "^([0-9]+)", 1).try_cast("long")
    stated = F.nullif(F.regexp_extract("range", "@([0-9]+)", 1), F.lit("")).try_cast("long")
    timed = one.withColumns({"e": end, "length": length, "_stated": stated, "idx": (F.row_number().over(order) - 1).cast("long")}).withColumn("s", F.col("e") - F.col("seconds"))
    # Offsets run on per URI from the last one stated: an island per statement, and sums within.
    own = Window.partitionBy("url", "uri").orderBy("_block")
    island = timed.withColumn("_island", F.sum(F.when(F.col("_stated").isNotNull(), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("url", "uri", "_island").orderBy("_block")
    start = F.coalesce(F.first("_stated").over(within), F.lit(0).cast("long"))
    before = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return island.select("url", "idx", "uri", "s", "e", F.nullif("key_uri", F.lit("")).alias("key_uri"), "map_uri", F.when(F.col("length").isNotNull(), start + before).alias("offset"), "length", "discontinuity", "gap")


def summaries(df: DataFrame) -> DataFrame:
    """(url, segments, total): what discovery needs of a playlist, read from its own lines without ordering them."""
    lines = F.split("body", "\r?\n")
    seconds = F.transform(F.filter(lines, lambda x: x.startswith("#EXTINF:")), lambda x: F.coalesce(F.regexp_extract(x, r"^#EXTINF:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0)))
    return df.select("url", F.size(seconds).cast("long").alias("segments"), F.aggregate(seconds, F.lit(0.0), lambda a, b: a + b).alias("total"))


def dash_duration(text: Column) -> Column:
    """The duration that a DASH description states, as text."""
    return xml_attribute(F.regexp_extract(text, r"(?is)<MPD\b([^>]*)>", 1), "mediaPresentationDuration")


def xml_attribute(text: Column, name: str) -> Column:
    """An attribute's value, in quotes of either kind, its entities decoded; null if it is missing or empty."""
    quoted = F.regexp_extract(text, rf"""(?i)(?<![\w:.-]){name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    value = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.nullif(value, F.lit(""))


def dash_representations(df: DataFrame) -> DataFrame:
    """(url, set_no, rep_no, id, bandwidth, mime, codecs, base, duration, template fields, timeline): representations with
    what they inherit from their adaptation set."""
    body = F.col("body")
    top = df.select("url", iso_duration(xml_attribute(F.regexp_extract(body, r"(?is)<MPD\b([^>]*)>", 1), "mediaPresentationDuration")).alias("duration"), F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)(<AdaptationSet\b.*?</AdaptationSet>)"), 1)).alias("set_no", "set"))
    inner = F.regexp_extract_all("set", F.lit(r"(?is)(<Representation\b(?:[^>]*/>|.*?</Representation>))"), 1)
    outer = F.regexp_replace("set", r"(?is)<Representation\b(?:[^>]*/>|.*?</Representation>)", "")
    reps = top.withColumn("outer", outer).select("url", "duration", "set_no", "outer", F.posexplode(inner).alias("rep_no", "rep"))
    tag = lambda c, name: F.regexp_extract(c, rf"(?is)<{name}\b([^>]*)>", 1)
    mine = lambda name: F.coalesce(xml_attribute(tag("rep", "Representation"), name), xml_attribute(tag("outer", "AdaptationSet"), name))
    holder = F.when(F.col("rep").rlike("(?i)<SegmentTemplate"), F.col("rep")).otherwise(F.col("outer"))
    base = lambda c: F.nullif(F.trim(F.regexp_extract(c, r"(?is)<BaseURL[^>]*>(.*?)</BaseURL>", 1)), F.lit(""))
    template = reps.withColumn("t", holder).withColumn("ta", tag("t", "SegmentTemplate"))
    number = lambda name, default: F.coalesce(xml_attribute(F.col("ta"), name).try_cast("long"), F.lit(default).cast("long"))
    entries = F.transform(F.regexp_extract_all("t", F.lit(r"(?is)<S\b([^>]*?)/?>"), 1), lambda x: F.struct(*[F.coalesce(xml_attribute(x, n).try_cast("long"), F.lit(0).cast("long")).alias(n) for n in "tdr"]))
    return template.select("url", "set_no", "rep_no", mine("id").alias("id"), F.coalesce(mine("bandwidth").try_cast("long"), F.lit(0).cast("long")).alias("bandwidth"), mine("mimeType").alias("mime"), mine("codecs").alias("codecs"), F.coalesce(base("rep"), base("outer"), F.lit("")).alias("base"), "duration", xml_attribute(F.col("ta"), "initialization").alias("initialization"), xml_attribute(F.col("ta"), "media").alias("media"), number("timescale", 1).alias("timescale"), number("startNumber", 1).alias("start_number"), number("duration", 0).alias("segment_duration"), entries.alias("timeline"))


def dash_segments(reps: DataFrame) -> DataFrame:
    """(url, set_no, rep_no, number, uri, s, e): the timeline run out, or segments of a fixed length over the duration."""
    key = ["url", "set_no", "rep_no"]
    has_line = F.size("timeline") > 0
    runs = reps.where(has_line).select(*key, "id", "bandwidth", "media", "timescale", "start_number", "duration", F.posexplode("timeline").alias("n", "x")).where("x.d > 0")
    order = Window.partitionBy(*key).orderBy("n")
    # A start above zero sets the clock: islands, within which starts are sums of the runs before. A run that repeats
    # without end lasts to the next stated start or to the presentation's end, so it ends its island.
    island = F.sum(F.when(F.col("x.t") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumns({"_island": island, "_next": F.lead("x.t").over(order)})
    within = Window.partitionBy(*key, "_island").orderBy("n")
    fixed = F.when(F.col("x.r") >= 0, (F.col("x.r") + 1) * F.col("x.d")).otherwise(0)
    at = F.first("x.t").over(within) + F.coalesce(F.sum(fixed).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = runs.withColumn("at", at)
    until = F.when(F.col("_next") > F.col("at"), F.col("_next").cast("double")).otherwise(F.coalesce(F.col("duration"), F.lit(0.0)) * F.col("timescale"))
    open_count = F.greatest(F.lit(0).cast("long"), F.ceil((until - F.col("at")) / F.col("x.d")).cast("long") - 1)
    runs = runs.withColumn("repeats", F.when(F.col("x.r") >= 0, F.col("x.r")).when(until > F.col("at"), open_count).otherwise(F.lit(0).cast("long")))
    first = F.col("start_number") + F.coalesce(F.sum(F.col("repeats") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    lined = runs.withColumn("first", first).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats"))))
    start = (F.col("at") + F.col("k") * F.col("x.d")) / F.col("timescale")
    lined = lined.select(*key, "id", "bandwidth", "media", (F.col("first") + F.col("k")).alias("number"), start.alias("s"), (start + F.col("x.d") / F.col("timescale")).alias("e"))
    size = F.col("segment_duration") / F.col("timescale")
    even = reps.where(~has_line & (F.col("segment_duration") > 0) & (F.col("duration") > 0)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / size).cast("long") - 1)))
    even = even.select(*key, "id", "bandwidth", "media", (F.col("start_number") + F.col("k")).alias("number"), (F.col("k") * size).alias("s"), F.least(F.col("duration"), (F.col("k") + 1) * size).alias("e"))
    both = lined.unionByName(even).where("media is not null and e > s")
    width = F.coalesce(F.nullif(F.regexp_extract("media", r"\$Number%0([0-9]+)d\$", 1), F.lit("")).try_cast("int"), F.lit(0))
    text = F.col("number").cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text)
    uri = F.replace(F.replace(F.col("media"), F.lit("$RepresentationID$"), F.coalesce("id", F.lit(""))), F.lit("$Bandwidth$"), F.col("bandwidth").cast("string"))
    uri = F.replace(F.replace(uri, F.lit("$Number$"), padded), F.concat(F.lit("$Number%0"), width.cast("string"), F.lit("d$")), padded)
    return both.select(*key, "number", uri.alias("uri"), "s", "e")


def prepare(spark) -> None:
    ship(spark)
