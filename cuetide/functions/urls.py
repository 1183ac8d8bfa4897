"""URLs of media and pages: parts, kinds, canonical forms and identities. Expressions on strings; nothing is fetched.

Parts are read by pattern, for absolute URLs with a scheme; hosts are lower-cased, default ports and dot segments stay.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuetide.functions.text import decode_for_urls, let

# Extensions by kind.
AUDIO_EXTENSIONS = ["aac", "flac", "m4a", "mp3", "oga", "ogg", "opus", "wav", "weba"]
MANIFEST_EXTENSIONS = ["m3u8", "m3u", "mpd"]
OTHER_EXTENSIONS = ["mp4", "m4s", "ts", "webm"]
_SHAPE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def is_absolute(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(_SHAPE)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 2)
    return F.when(is_absolute(url) & (found == ""), "/").otherwise(found)


def query_text(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 3)


def filename(url: Column) -> Column:
    """The decoded last part of the path; text that is no URL is its own name."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.when(is_absolute(url), F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)).otherwise(F.coalesce(url, F.lit("")))


def extension(url: Column) -> Column:
    return F.lower(F.element_at(F.split(path(url), r"\."), -1))


def query_value(url: Column, name: str) -> Column:
    raw = F.regexp_extract(query_text(url), f"(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def content_type(c: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), ";"), 1)))


def is_placeholder(url: Column) -> Column:
    """Known media URLs that hold no media."""
    h, p = host(url), F.lower(path(url))
    return ((h == "cdn.plyr.io") & (p == "/static/blank.mp4")) | (h.endswith("youtube.com") & (p == "/s/search/audio/no_input.mp3"))


def media_kind(url: Column) -> Column:
    """audio, media, hls, dash or null: by the mime parameter, then playback hosts, then the extension. The playback host
    and path are fixed values."""
    mime = content_type(F.coalesce(F.nullif(query_value(url, "mime"), F.lit("")), query_value(url, "mimeType")))
    playback = host(url).rlike(r"(^|\.)googlevideo\.com$") & path(url).rlike("(?i)/videoplayback$")
    parts = F.struct(extension(url).alias("ext"), mime.alias("mime"), playback.alias("playback"), (is_absolute(url) & ~is_placeholder(url)).alias("counts"))

    def kind(x: Column) -> Column:
        ext, mime = x["ext"], x["mime"]
        by_type = F.when(mime.startswith("audio/"), "audio").when(mime.startswith("video/"), "media").when(F.contains(mime, F.lit("mpegurl")), "hls").when(F.contains(mime, F.lit("dash+xml")), "dash").when(x["playback"], "media")
        known = by_type.when(ext.isin(AUDIO_EXTENSIONS), "audio").when(ext == "mpd", "dash").when(ext.isin(MANIFEST_EXTENSIONS), "hls").when(ext.isin(OTHER_EXTENSIONS), "media")
        return F.when(x["counts"], known)

    return let(parts, kind)


def kind_of_type(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.startswith("audio/"), "audio").when(F.contains(t, F.lit("dash+xml")), "dash").when(F.contains(t, F.lit("mpegurl")), "hls").otherwise("media")


# Tokens of a path that tell variants of one stream apart, in the order in which they are replaced.
_VARIANTS = [
    (r"/\d{3,5}x\d{3,5}(?=/)", "/{resolution}"),
    (r"(?i)/(?:\d{3,4}p|[1-9]\d{1,3}k|[48]k)(?=/)", "/{quality}"),
    (r"(?i)(?:^|[-_/])f\d+[-_.][av]\d+(?=[-_/.]|$)", "-{track}"),
    (r"(?i)(?:^|[-_/])[av]\d+(?=[-_/.]|$)", "-{track}"),
    (r"(?i)(?:^|[-_/])\d{3,4}p(?=[-_/.]|$)", "-{quality}"),
    (r"(?i)(?:^|[-_/])(?:[1-9]\d{1,3}k|[48]k)(?=[-_/.])", "-{quality}"),
]
_SEGMENT_TRACK = (r"(?i)-\d{5,6}(?=\.m4s$)", "-{track}")


def _replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, token in rules:
        c = F.regexp_replace(c, pattern, token.replace("{", r"\{").replace("}", r"\}"))
    return c


def canonical_path(p: Column) -> Column:
    return _replaced(p, [*_VARIANTS, _SEGMENT_TRACK])


def family_path(url: Column) -> Column:
    """What all variants of a stream have in common."""
    return _replaced(canonical_path(path(url)), _VARIANTS)


# Hosts and paths of a site whose media have an identity and a track number in their names.
_SITE_HOST, _SITE_PATH = r"(?i)(?:^|\.)(?:bilibili(?:video)?\.com|bilivideo\.(?:com|cn))$", r"(?i)/upgcxcode/"
_SITE_MEDIUM, _SITE_TRACK = r"(?i)/upgcxcode/(?:[^/]+/){0,4}(\d+)(?:/|$)", r"(?i)^(\d+-\d+)-(\d+)\.(?:m4s|mp4)$"


def site_medium(url: Column) -> Column:
    """The identity of a site's medium, the same on all of its hosts; null for other URLs."""
    name, by_path = F.regexp_extract(filename(url), _SITE_TRACK, 1), F.regexp_extract(path(url), _SITE_MEDIUM, 1)
    return F.when(host(url).rlike(_SITE_HOST) | path(url).rlike(_SITE_PATH), F.coalesce(F.nullif(name, F.lit("")), F.nullif(by_path, F.lit("")), family_path(url)))


def site_track(url: Column) -> Column:
    """The track number in the name of such a medium, else null."""
    return F.nullif(F.regexp_extract(filename(url), _SITE_TRACK, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    return F.when(is_absolute(url), F.concat(host(url), canonical_path(path(url)))).otherwise(F.coalesce(url, F.lit("")))


def exact_url(url: Column) -> Column:
    """Host, path and query."""
    q = query_text(url)
    return F.when(is_absolute(url), F.concat(host(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise(F.coalesce(url, F.lit("")))


# Query parameters that follow visitors, and those that grant access.
TRACKING = r"(?i)^(utm_|spm_|vd_source$|from$|share_|fbclid$|gclid$)"
SENSITIVE = r"(?i)^(token$|access_?token$|auth(?:_key)?$|authorization$|signature$|sign$|sig$|policy$|key-pair-id$|awsaccesskeyid$|expires?$|expiration$|deadline$|timestamp$|ts$|nonce$|session(?:id)?$|sid$|x-amz-|x-oss-|x-goog-)"


def cache_url(url: Column, tracking: bool = True) -> Column:
    """Without fragment and without parameters that track or grant access, the others sorted by name."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    base = F.regexp_replace(bare, r"\?.*$", "")
    base = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*$"), F.concat(base, F.lit("/"))).otherwise(base)
    parts = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("name"), p.alias("part")))
    keep = lambda x: ~x["name"].rlike(SENSITIVE) & (~x["name"].rlike(TRACKING) if tracking else F.lit(True))
    kept = F.transform(F.array_sort(F.filter(named, keep)), lambda x: x["part"])
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def quality(url: Column) -> Column:
    """(width, height, bandwidth) as far as the URL tells; a resolution outranks a height. The parameter names of the
    bandwidth are fixed values."""
    text = F.lower(F.concat_ws(" ", path(url), query_text(url)))
    number = lambda pattern, at=1: F.nullif(F.regexp_extract(text, pattern, at), F.lit("")).cast("long")
    shape = r"(\d{3,5})[x_](\d{3,5})"
    height = F.coalesce(number(shape, 2), number(r"(?:^|[^\d])(\d{3,4})p(?:[^\d]|$)"))
    bandwidth = F.coalesce(number(r"(?:bandwidth|bw|br)=(\d+)"), number(r"(?:^|[^\d])([1-9]\d{1,3})(?:k|kbps)(?:[^\d]|$)") * 1000)
    return F.struct(number(shape).alias("width"), height.alias("height"), bandwidth.alias("bandwidth"))


def media_role(kind: Column, url: Column, type_: Column, has_size: Column) -> Column:
    """audio, video, playlist or media. The names in a path that mean sound alone are fixed values."""
    ext, ctype = extension(url), content_type(type_)
    audio_only = path(url).rlike(r"(?i)(?:^|[-_/])(?:audio|aac|m4a|mp3|opus)(?:[-_.]|$)") | path(url).rlike(r"(?i)(?:^|[-_/])(?:f\d+[-_.])?a\d+(?=[-_./]|$)")
    manifest = kind.isin("hls", "dash")
    segment = (ext == "m4s") & F.contains(ctype, F.lit("iso.segment"))
    return (
        F.when((kind == "audio") | ext.isin(AUDIO_EXTENSIONS), "audio").when(manifest & audio_only, "audio").when(manifest, "playlist")
        .when((ctype.startswith("video/") & ~segment) | has_size, "video").when(ctype.startswith("audio/") | path(url).rlike("(?i)/audio/"), "audio").otherwise("media")
    )


def codec_is_audio(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:mp4a|ac-3|ec-3|opus|vorbis|flac|alac)(?:\.|$)")


def codecs_are_audio(c: Column) -> Column:
    """All of a list of codecs, of which there is one at least."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, codec_is_audio)


def container_hint(url: Column) -> Column:
    ext = F.lower(F.element_at(F.split(F.element_at(F.split(F.coalesce(url, F.lit("")), r"\?"), 1), r"\."), -1))
    return F.when(ext.isin("cmfa", "cmfv", "cmf", "m4s", "m4a", "m4v", "mp4"), "fmp4").otherwise(ext)


def sequence_number(url: Column) -> Column:
    """The last number in a file's name."""
    return F.nullif(F.regexp_extract(filename(url), r"(\d+)(?=\D*$)", 1), F.lit("")).try_cast("long")


def page_identity(url: Column) -> Column:
    """Origin and path."""
    return F.when(is_absolute(url), F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1)), host(url), path(url))).otherwise(F.coalesce(url, F.lit("")))


def _without_dots(p: Column) -> Column:
    """A path without . and .. parts."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(p.rlike(r"/\.\.?(?:/|$)"), F.when(joined == "", "/").otherwise(joined)).otherwise(p)


def resolve(base: Column, reference: Column) -> Column:
    """A reference made absolute by the URL it stands in: absolute ones stay, others take over scheme, host, directory or
    path. Null references stay null; without an absolute base they stay as they are."""
    base, ref = F.coalesce(base, F.lit("")), F.trim(reference)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme, own = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), path(base)
    name, rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    directory = F.regexp_replace(own, "[^/]*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (origin == ""), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref == "", F.regexp_replace(base, "#.*$", ""))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(name), rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(directory, name)), rest))
    )


#: Absolute and protocol-relative URLs in running text or markup.
_IN_TEXT = r"(?i)((?:https?:)?//[a-z0-9\[][^\s\"'<>\\\\)]*)"


def sniffed(text: Column, base: Column) -> Column:
    """What a text is (hls, dash or text) and the distinct URLs in it, entities decoded and made absolute: a struct of format
    and urls. A manifest is itself what its own URL means."""
    head = F.coalesce(text, F.lit(""))
    form = F.when(head.startswith("#EXTM3U") | F.contains(head, F.lit("\n#EXTM3U")), "hls").when(F.contains(head, F.lit("urn:mpeg:dash:schema:mpd")) | head.rlike(r"<MPD[\s>]"), "dash").otherwise("text")
    decoded = decode_for_urls(head)
    found = F.transform(F.array_distinct(F.regexp_extract_all(decoded, F.lit(_IN_TEXT), 1)), lambda u: resolve(base, u))
    return F.struct(form.alias("format"), F.when(form == "text", F.array_distinct(found)).otherwise(F.array(base)).alias("urls"))


def same_origin(a: Column, b: Column) -> Column:
    """Whether captured headers may go along: equal URLs and empty ones pass, else scheme and host must agree."""
    origin = lambda u: F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    return F.coalesce((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b) | ((origin(a) == origin(b)) & (origin(a) != "")), F.lit(False))
