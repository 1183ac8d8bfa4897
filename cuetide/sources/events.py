"""Media candidates from events of the network, of pages, of resource timings and of structured objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions import urls
from cuetide.session import ship

# Types of requests that are looked at, and content types of media.
REQUEST_TYPES = ["media", "xmlhttprequest", "other"]
MEDIA_TYPES = r"audio/|video/|application/dash\+xml|application/m4s|application/octet-stream|application/vnd\.apple\.mpegurl|application/x-mpegurl|application/mpegurl"
GENERIC_TYPE = "application/octet-stream"


def _known(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) != ""


def network_events(df: DataFrame) -> DataFrame:
    """df: tab, url, event (request-headers, request or response), request_type, content_type and more. Those that are
    candidates, with source, kind and ext: requests whose URL tells their kind; responses also by their content type,
    unless that is generic. Works on streams as on tables."""
    u, typed = F.col("url"), F.col("request_type").isin(REQUEST_TYPES)
    # The kind by URL is a column of its own, so that its patterns are not spelled out at each use.
    df, kind = df.withColumn("kind", urls.media_kind(u)), F.col("kind")
    by_url, given = kind, F.lower(F.coalesce("content_type", F.lit("")))
    by_type = given.rlike(MEDIA_TYPES) & (urls.content_type(F.col("content_type")) != GENERIC_TYPE)
    wanted = (
        F.when(F.col("event") == "request-headers", by_url.isNotNull())
        .when(F.col("event") == "request", typed & by_url.isNotNull())
        .when(F.col("event") == "response", typed & (given != "") & (by_url.isNotNull() | by_type))
    )
    kept = df.where((F.col("tab") >= 0) & _known(u) & ~urls.is_placeholder(u) & F.coalesce(wanted, F.lit(False)))
    added = {"source": F.col("event"), "kind": F.coalesce(by_url, urls.kind_of_type(given)), "ext": F.when(by_url.isNotNull(), urls.extension(u)).otherwise("")}
    return kept.withColumns(added)


def page_events(df: DataFrame) -> DataFrame:
    """df: tab, frame, url, kind, ext, source and more, as pages report them. Without placeholders and URLs that hold their
    data; what the page leaves open is taken from the URL."""
    u = F.col("url")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    kept = df.where((F.col("tab") > 0) & _known(u) & ~urls.is_placeholder(u) & ~u.rlike("^(?:blob|data):"))
    known = urls.media_kind(u)
    return kept.withColumns({"frame": F.coalesce("frame", F.lit(0)), "source": F.coalesce(blank("source"), F.lit("page")), "kind": F.coalesce(blank("kind"), known, F.lit("media")), "ext": F.coalesce(blank("ext"), F.when(known.isNotNull(), urls.extension(u)), F.lit(""))})


def resource_timings(df: DataFrame, keys: tuple[str, ...] = ("tab",)) -> DataFrame:
    """df: the keys, url, at, transfer_size, encoded_size, decoded_size. Each URL once, as it came first, if its kind is
    known: (keys, url, kind, ext, source, size), the size being the first of the three that is not zero."""
    first = df.where(_known(F.col("url"))).groupBy(*keys, "url").agg(F.min_by(F.struct("transfer_size", "encoded_size", "decoded_size"), "at").alias("x"))
    size = F.coalesce(*[F.nullif(F.col(f"x.{c}"), F.lit(0)) for c in ("transfer_size", "encoded_size", "decoded_size")], F.lit(0))
    kind = urls.media_kind(F.col("url"))
    return first.where(kind.isNotNull()).select(*keys, "url", kind.alias("kind"), urls.extension(F.col("url")).alias("ext"), F.lit("performance-entry").alias("source"), size.alias("size"))


_PLAIN = ("url", "baseUrl", "base_url")
_CIPHERS = ("signatureCipher", "cipher")
_BACKUPS = ("backupUrl", "backup_url", "backupUrls")


def _objects(value: object, depth: int, most: int) -> Iterator[tuple[dict, int]]:
    if depth > most:
        return
    if isinstance(value, dict):
        yield value, depth
        value = list(value.values())
    if isinstance(value, list):
        for item in value:
            yield from _objects(item, depth + 1, most)


def _number(*values: object) -> int | None:
    """The first value that is neither empty nor zero, as a whole number; null if it is none, or beyond 64 bits."""
    for value in values:
        if value:
            try:
                found = int(str(value)) if str(value).strip().lstrip("+-").isdecimal() else int(float(str(value)))
            except (ValueError, OverflowError):
                return None
            return found if -(1 << 63) <= found < 1 << 63 else None
    return None


def structured_media(df: DataFrame, key: str, payload: str = "payload", most_depth: int = 8) -> DataFrame:
    """df: key and JSON text of any shape. A row for each distinct URL of each object down to a depth whose kind the URL or
    the object's type tells: (key, url, kind, ext, content_type, size, width, height, bandwidth, label, depth). Objects name
    URLs under known keys, in lists of backups, or in ciphers. Text that is no JSON, or is nested beyond what the parser
    takes (some thousand levels), gives none; numbers that are none, or need more than 64 bits, are null."""
    ship(df.sparkSession)
    schema = df.select(key).schema[0].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import parse_qs

        for frame in frames:
            rows = []
            for own, text in zip(frame[key], frame[payload], strict=True):
                try:
                    top = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                for found, depth in _objects(top, 0, most_depth):
                    named = [found.get(n) for n in _PLAIN]
                    named += [parse_qs(c).get("url", [""])[0] for c in (found.get(n) for n in _CIPHERS) if isinstance(c, str)]
                    for n in _BACKUPS:
                        more = found.get(n)
                        named += more if isinstance(more, list) else [more]
                    mime = str(found.get("mimeType") or found.get("mime") or found.get("contentType") or "")
                    size = _number(found.get("contentLength"), found.get("size"), found.get("clen"))
                    rate = _number(found.get("bitrate"), found.get("averageBitrate"), found.get("bandwidth"))
                    label = str(found.get("qualityLabel") or found.get("quality") or found.get("audioQuality") or "")
                    rows += [(own, u, mime, size, _number(found.get("width")), _number(found.get("height")), rate, label, depth) for u in dict.fromkeys(u for u in named if isinstance(u, str) and u.strip())]
            yield pd.DataFrame(rows, columns=[key, "url", "mime", "size", "width", "height", "bandwidth", "label", "depth"], dtype=object).astype({c: "Int64" for c in ("size", "width", "height", "bandwidth")})

    found = df.select(key, payload).mapInPandas(walk, f"`{key}` {schema}, url string, mime string, size long, width long, height long, bandwidth long, label string, depth int")
    mime, by_url = urls.content_type(F.col("mime")), urls.media_kind(F.col("url"))
    kind = F.when(mime.startswith("audio/"), "audio").otherwise(F.coalesce(by_url, F.lit("media")))
    typed = mime.startswith("audio/") | mime.startswith("video/")
    ext = F.when(by_url.isNotNull(), urls.extension(F.col("url"))).otherwise("")
    return found.where(by_url.isNotNull() | typed).select(key, "url", kind.alias("kind"), ext.alias("ext"), mime.alias("content_type"), "size", "width", "height", "bandwidth", "label", "depth")
