"""Text of segments: cleaning, comparison keys and classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuetide.params import P

#: White space as browsers understand it, for Java and RE2 alike.
WS = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Punctuation left out of comparison keys, and the wider set with wave dashes.
PUNCT = r""".,!?;:'"()\[\]{}，。！？；：“”‘’（）【】《》、·…—\-"""
PUNCT_WIDE = PUNCT + "~〜ー"
CJK = r"\x{3400}-\x{9fff}"
TAG = "<[^>]+>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", " "), "^ | $", "")


def _entities(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for name, char in pairs:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
ENTITIES_WIDE = [*ENTITIES, ("&quot;", '"'), ("&#39;", "'")]


def clean_cue(c: Column) -> Column:
    """Tags out, four entities decoded, white space squeezed."""
    return squeeze(_entities(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, ""), ENTITIES))


def clean_plain(c: Column) -> Column:
    """Tags out and white space squeezed; entities stay."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), TAG, ""))


def clean_import(c: Column) -> Column:
    """Text of imported files: style overrides and tags out, line marks to blanks, then six entities decoded."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\[Nn]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", ""), TAG, "")
    return _entities(squeeze(c), ENTITIES_WIDE)


def decode_for_urls(c: Column) -> Column:
    """Entities that hide URLs in markup, in any case."""
    for pattern, char in [("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&#x3d;|&#61;", "="), ("&lt;", "<"), ("&gt;", ">")]:
        c = F.regexp_replace(c, f"(?i){pattern}", char)
    return c


def repeat_key(c: Column) -> Column:
    """By which texts count as repeats: lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[{WS}{PUNCT}]+", "")


def compact_key(c: Column) -> Column:
    """As repeat_key, but cleaned first, in its own case, and without wave dashes."""
    return F.regexp_replace(clean_cue(c), f"[{WS}{PUNCT_WIDE}]+", "")


def content_length(c: Column) -> Column:
    """Code points that are neither white space nor punctuation."""
    return F.length(F.regexp_replace(clean_cue(c), f"[{WS}{PUNCT}]+", "")).cast("long")


def is_punctuation(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"^[{WS}{PUNCT}]+$")


def run_key_counts(key: Column) -> Column:
    """Whether a repeat of the key can be an error: long enough, or shorter but not in Latin script."""
    n = F.length(key)
    return (n >= P.run_min_chars) | ((n >= P.run_min_chars_other_scripts) & key.rlike(r"[^\p{IsLatin}\p{N}_]"))


def information_kind(c: Column) -> Column:
    """`punctuation`, `low_information` (one unit repeated, few different characters, a lone sign) or null. The cleaned text
    and its key are computed once, and the cleaning only of texts that hold something to clean."""

    def low(compact: Column) -> Column:
        n = F.length(compact)
        few = (n >= 8) & (F.size(F.array_distinct(F.split(compact, "(?s)(?<=.)(?=.)"))) / n <= 0.25)
        latin_low = ((n <= 4) & ~compact.rlike("[aeiouy]")) | compact.rlike(r"^(.{1,4}?)\1{2,}$")
        other_low = (n == 1) | compact.rlike(r"^(.{1,4}?)\1+$")
        return (n > 0) & ~compact.rlike(r"\p{N}") & (F.when(compact.rlike("^[a-z]+$"), latin_low).otherwise(other_low) | few)

    def kind(raw: Column) -> Column:
        compact = F.regexp_replace(F.lower(raw), f"[{WS}{PUNCT_WIDE}]+", "")
        punctuation = ~raw.rlike(f"[^{WS}{PUNCT}]")
        return F.when(raw == "", None).when(punctuation, "punctuation").when(let(compact, low), "low_information")

    text = F.coalesce(c, F.lit(""))
    return let(F.when(text.rlike(f"[<&{WS}]"), clean_cue(c)).otherwise(text), kind)


def is_repeated_phrase(c: Column, seconds: Column) -> Column:
    """One phrase makes up most of a long text. Equal phrases are counted as runs of the sorted list."""
    pieces = F.split(clean_cue(c), r"[、,，。.!?！？;；\n]+")
    parts = F.array_sort(F.filter(F.transform(pieces, repeat_key), lambda x: F.length(x) >= P.phrase_min_chars))
    state = "struct<last:string,run:int,most:int>"

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most")).cast(state)

    begin = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")).cast(state)
    enough = F.aggregate(parts, begin, step, lambda acc: (acc["most"] >= P.phrase_count) & (acc["most"] / F.size(parts) >= P.phrase_share))
    return F.coalesce(F.when(seconds >= P.phrase_span, enough), F.lit(False))


def is_low_single(kind: Column, c: Column, seconds: Column) -> Column:
    """kind: of information_kind(c)."""
    low = F.coalesce((kind == "low_information") & (seconds >= P.low_single_span), F.lit(False))
    return F.coalesce((seconds > 0) & (low | is_repeated_phrase(c, seconds)), F.lit(False))


def join_words(words: Column) -> Column:
    """Words as text; without blanks if any has a CJK character."""
    return F.when(F.exists(words, lambda w: w.rlike(f"[{CJK}]")), F.array_join(words, "")).otherwise(F.array_join(words, " "))


def model_json(c: Column) -> Column:
    """The JSON text in a model's answer: without code fences, or from its first brace to the last; null if neither parses."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^```(?:json)?|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(ok(bare), ok(inner))


# Signs of a service's errors.
_RATE = "429|rate limit|too many requests|请求过多|限流|频率限制"
_POLICY = "content (?:policy|safety|filter|moderation)|safety policy|policy violation|moderation|moderated|violat(?:e|ion)|sensitive content|blocked content|内容.{0,8}(?:安全|审核|审查|违规|过滤)|审核|审查|违规|敏感内容"
_PERMANENT = "401|403|404|unauthorized|forbidden|invalid api key|api key|invalid key|authentication|quota|不存在的模型|模型不存在"


def error_kind(message: Column) -> Column:
    """content_policy, rate_limited, permanent or transient; the first that fits."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike(_POLICY), "content_policy").when(m.rlike(_RATE), "rate_limited").when(m.rlike(_PERMANENT), "permanent").otherwise("transient")


#: Names and tags of languages, by the tag they stand for.
LANGUAGE_NAMES = {
    "": ["auto", "automatic", "detect", "default", "自动", "自动识别"],
    "zh": ["zh-cn", "zh-hans", "zh", "chinese", "中文"],
    "en": ["en", "english", "英语", "英文"],
    "ja": ["ja", "jp", "japanese", "日语"],
    "fr": ["fr", "french", "法语"],
    "ko": ["ko", "kr", "korean", "韩语"],
    "de": ["de", "german", "德语"],
    "ru": ["ru", "russian", "俄语"],
    "es": ["es", "spanish", "西语", "西班牙语"],
    "pt": ["pt", "portuguese", "葡语", "葡萄牙语"],
    "it": ["it", "italian", "意语", "意大利语"],
}


def language_code(c: Column) -> Column:
    """A language name or tag as a tag; unknown ones in lower case, with a hyphen for the first underscore."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^([^_]*)_", "$1-")
    found = F.lit(None).cast("string")
    for tag, names in LANGUAGE_NAMES.items():
        found = F.when(low.isin(names), tag).otherwise(found)
    return F.coalesce(found, low)


def safe_filename(c: Column, default: str = "subtitles", most: int = 80) -> Column:
    """Without characters that file systems refuse, squeezed and cut."""
    name = squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]+', " "))
    return F.left(F.when(name == "", default).otherwise(name), F.lit(most))


def useful_title(*titles: Column) -> Column:
    """The first title that is more than a frame's or an empty page's."""
    kept = [F.when(~squeeze(t).rlike("(?i)^(?:|cross origin local storage|about:blank|iframe)$"), squeeze(t)) for t in titles]
    return F.coalesce(*kept, F.lit(""))


def cache_key(page: Column, source: Column) -> Column:
    """Of normalised page and media URLs, empty where unknown; null if both are."""
    seed = F.when((page != "") & (source != ""), F.concat(F.lit("page:"), page, F.lit("\nsource:"), source)).when(page != "", F.concat(F.lit("page:"), page)).when(source != "", F.concat(F.lit("source:"), source))
    return F.concat(F.lit("subtitle:v4:"), F.sha2(seed.cast("binary"), 256))


def content_signature(c: Column) -> Column:
    """length:hash, the hash being 31-fold over the characters in 32 bits, without its sign."""
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    rolled = F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)) % F.lit(1 << 32))
    signed = F.when(rolled >= 1 << 31, F.lit(1 << 32) - rolled).otherwise(rolled)
    return F.concat_ws(":", F.length(F.coalesce(c, F.lit(""))).cast("string"), signed.cast("string"))


def _tenths(c: Column) -> Column:
    rounded = F.floor(c * 10 + 0.5)
    return F.when(rounded % 10 == 0, F.floor(rounded / 10).cast("string")).otherwise((rounded / 10).cast("decimal(20,1)").cast("string"))


def human_bytes(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.concat(_tenths(n / (1 << 20)), F.lit(" MB"))).when(n >= 1024, F.concat(_tenths(n / 1024), F.lit(" KB"))).otherwise(F.concat(F.floor(n + 0.5).cast("string"), F.lit(" B")))


def human_duration(seconds: Column) -> Column:
    total = F.floor(seconds + 0.5).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(total <= 0, "").when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))
