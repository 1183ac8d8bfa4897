"""Personal data by weak-supervision aggregation, in DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of four patterns, those that fail a check (numbers up to 255, digit
counts, Luhn) being dropped. Their patterns below are written so that matching takes linear time: a run of characters is
only entered at its start, and runs that could not pass are not matched, which leaves the same spans.

Beyond them the method finds spans of three more kinds: secret, local_phone and name. Wide patterns propose candidates;
four labelers vote on each (yes, no, abstain): a strict pattern, a gazetteer of words that announce such data or of given
names, the characters around, and the span's own shape. Votes are counted by kind and pattern of votes, at most
3 x 81 rows whatever the input, on which expectation-maximisation estimates each labeler's reliability. The resulting
probabilities are soft labels for the final span classifier, naive Bayes over bucketed features, whose weights (a few
dozen numbers) become literals of the expression that accepts or rejects a candidate. An accepted span that overlaps a
base span, or an accepted one of a kind listed before its own, is left out.

Offsets count code points, the end is exclusive. Null texts are empty. Everything happens within a row, apart from the
two counts, so repeated rows, ties and skew need no care; documents without spans get zeros and empty strings, and
empty tables train on nothing: then no candidate is accepted. report() ignores columns beyond doc_id and text; redact()
changes the text alone and keeps all other columns, whatever their names.

Texts of any length and kind: no pattern backtracks or recurses with the text (repeated groups are possessive, which
Java matches in a loop), places are running sums over blocks of matches, and a candidate's context comes from the
text between matches, so time grows in proportion to the text and its matches. A text's matches are held at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.llm.common import spare, stored

# Patterns of the base kinds, with guards at the start of a run in place of retries within it.
_LOCAL = r"[A-Za-z0-9._%+\-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20\-])[0-9](?:[\x20\-]?[0-9]){12,18}(?![\x20\-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
BASE_KINDS = ["email", "ip", "card", "phone"]
# Wide patterns of the further kinds.
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,64}+[0-9])(?=[0-9]{0,64}+[A-Za-z])[A-Za-z0-9]{8,64}+(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+.\-])\(?[0-9]{3}\)?[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}(?![0-9])"
NAME = r"(?<![\p{L}.])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame|Mme)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"
ADDED_KINDS = ["secret", "local_phone", "name"]
LABELERS = ["pattern", "gazetteer", "context", "shape"]

#: Words that announce a secret or a telephone number, and common given names.
_ANNOUNCES_SECRET = r"(?i)(?:token|passw(?:or)?d|passwort|pwd|secret|key|contraseña|clave)[\x20_\-]*[=:]?\s*[\"']?$"
_ANNOUNCES_PHONE = r"(?i)(?:tel|phone|call|fax|mobile|cell|anruf|telefon|llame|móvil|appel)\w*[.:]?\s*$"
_GIVEN = r"(?i)\x20(?:ana|anna|carlos|david|emma|hans|james|jean|john|jose|josé|juan|julia|karl|laura|lucas|luis|maria|marie|mary|michael|paul|peter|pierre|sarah|thomas)(?:\x20|$)"

CONTEXT = 40
#: Matches whose running sums are made in one go.
_RUN = 64
_SPAN = "array<struct<start:int,end:int,body:string>>"
_PLACE = "array<struct<start:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's parameter is, a repeated expression is not."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], first: int) -> Column:
    """Of an array of int the results of joining (sum, greatest, least: associative, first is neutral) all up to each
    place. Arrays only grow within a run of places, and over the runs' last results."""

    def within(part: Column) -> Column:
        state = "struct<at:int,out:array<int>>"
        begin = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out")).cast(state)

        def step(acc: Column, v: Column) -> Column:
            return let(join(acc["at"], v), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))).cast(state)

        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def joined(own: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _RUN).cast("int")), lambda at: within(F.slice(own, at * _RUN + 1, F.lit(_RUN))))
        return let(runs, lambda rs: let(within(F.transform(rs, lambda r: F.element_at(r, -1))), lambda ends: F.flatten(F.transform(rs, lambda r, i: let(F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(first)), lambda before: F.transform(r, lambda v: join(before, v)))))))

    return let(values, lambda own: F.when(F.size(own) > 0, joined(own)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, context: bool = False) -> Column:
    """Matches as (start, end, body), and on request (before, after): up to CONTEXT characters of the match before and the
    text between, and the two characters after."""

    def placed(m: Column) -> Column:
        steps = F.transform(m["found"], lambda _, i: F.length(F.get(m["gaps"], i)) + F.when(i > 0, F.length(F.get(m["found"], i - 1))).otherwise(F.lit(0)))
        around = lambda i: [
            F.right(F.concat(F.when(i > 0, F.get(m["found"], i - 1)).otherwise(F.lit("")), F.get(m["gaps"], i)), F.lit(CONTEXT)).alias("before"),
            F.substring(F.get(m["gaps"], i + 1), 1, 2).alias("after"),
        ]
        fields = lambda start, i: [start.alias("start"), (start + F.length(F.get(m["found"], i))).alias("end"), F.get(m["found"], i).alias("body")]
        return F.transform(running(steps, lambda a, b: a + b, 0), lambda start, i: F.struct(*fields(start, i), *(around(i) if context else [])))

    none = F.array().cast("array<struct<start:int,end:int,body:string,before:string,after:string>>" if context else _SPAN)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(body)), ""), lambda c: c != "")
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the array of (start, end, body)."""
    digit = text.rlike("[0-9]")
    none = F.array().cast(_SPAN)
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda s: s["body"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))).otherwise(none),
        "card": F.when(digit, F.filter(located(text, CARD), lambda s: _luhn(s["body"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda s: F.length(_digits(s["body"])).between(9, 15))).otherwise(none),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _turns(body: Column) -> Column:
    """How often letters and digits change place, roughly: the number of digit runs."""
    return F.size(F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0)))


def _votes(kind: str, body: Column, before: Column, after: Column) -> list[Column]:
    if kind == "secret":
        return [
            _vote(body.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{14,64})$"), F.length(body) < 10),
            _vote(before.rlike(_ANNOUNCES_SECRET), before.rlike(r"[\p{L}0-9]{3}[,.]?\x20$")),
            _vote(before.rlike("[=:\"']\\s*$"), before.rlike("[@/.]$") | after.rlike("^[@]")),
            _vote(_turns(body) >= 3, _turns(body) <= 1),
        ]
    if kind == "local_phone":
        return [
            _vote(body.rlike(r"^(?:\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}([.\-])[0-9]{3}\1[0-9]{4})$"), body.rlike(r"^[0-9]{3}\x20[0-9]{3}\x20")),
            _vote(before.rlike(_ANNOUNCES_PHONE), F.lit(False)),
            _vote(before.rlike(r"[:(]\s*$"), before.rlike(r"(?:[$€£#]|[0-9][,.\x20])\s*$") | after.rlike(r"^[.,\-][0-9]")),
            _vote(body.rlike(r"^\(?[2-9]"), body.rlike(r"^\(?[01]")),
        ]
    return [
        _vote(body.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$"), F.lit(False)),
        _vote(body.rlike(_GIVEN), F.lit(False)),
        _vote(before.rlike(r"(?i)(?:\b(?:by|from|with|to|von|mit|de|con|avec|par|por|dear|lieber?)\x20)$"), before.rlike(r"[\p{Ll}]$")),
        _vote(F.length(body).between(6, 40), F.length(body) > 40),
    ]


def _left_kind(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"^\p{L}"), "letter").when(c.rlike("^[0-9]"), "digit").when(c.rlike(r"^\s"), "space").when(c.rlike("^[=:\"']"), "given").otherwise("mark")


def candidates(text: Column) -> Column:
    """(kind, start, end, votes, features) of the further kinds, in order of kind and start. votes: a digit per labeler, 0
    no, 1 abstain, 2 yes. features: bucket numbers."""
    digit = text.rlike("[0-9]")
    found = [(digit, SECRET), (digit, LOCAL_PHONE), (F.lit(True), NAME)]
    kind_of = "array<struct<kind:string,start:int,end:int,votes:string,features:array<string>>>"
    parts = []

    def describe(kind: str):
        # transform() would pass the place to a second parameter, so the kind comes by closure.
        def described(s: Column) -> Column:
            body, before, after = s["body"], s["before"], s["after"]
            votes = F.concat(*[(v + 1).cast("string") for v in _votes(kind, body, before, after)])
            features = F.array(
                F.concat(F.lit("length:"), F.least(F.floor(F.length(body) / 4), F.lit(10)).cast("string")),
                F.concat(F.lit("digits:"), F.floor(4 * F.length(_digits(body)) / F.length(body)).cast("string")),
                F.concat(F.lit("turns:"), F.least(_turns(body), F.lit(5)).cast("string")),
                F.concat(F.lit("left:"), _left_kind(F.right(before, F.lit(1)))),
                F.concat(F.lit("right:"), _left_kind(F.left(after, F.lit(1)))),
            )
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), features.alias("features"))

        return described

    for kind, (guard, pattern) in zip(ADDED_KINDS, found, strict=True):
        spans = F.when(guard, F.transform(located(text, pattern, True), describe(kind))).otherwise(F.array().cast(kind_of))
        parts.append(spans.cast(kind_of))
    return F.concat(*parts)


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Expectation-maximisation over patterns of votes and how often each occurs: the probability that a span with the
    pattern is one. Labelers are taken as independent given the truth, each with its own chances of yes, no, abstain."""
    if not counts:
        return {}
    belief = {p: 1 / (1 + math.exp(-2 * sum(int(v) - 1 for v in p))) for p in counts}
    for _ in range(rounds):
        weight = [sum(n * (1 - belief[p]) for p, n in counts.items()), sum(n * belief[p] for p, n in counts.items())]
        prior = [math.log((w + 1) / (sum(weight) + 2)) for w in weight]
        chance = []
        for at in range(len(LABELERS)):
            told = [[1.0] * 3, [1.0] * 3]
            # What a labeler says is more likely right than wrong: a prior of a few votes keeps the two classes in place.
            told[1][2], told[0][0] = 3.0, 3.0
            for p, n in counts.items():
                told[1][int(p[at])] += n * belief[p]
                told[0][int(p[at])] += n * (1 - belief[p])
            chance.append([[math.log(x / sum(row)) for x in row] for row in told])
        for p in counts:
            no, yes = (prior[y] + sum(chance[at][y][int(v)] for at, v in enumerate(p)) for y in (0, 1))
            belief[p] = 1 / (1 + math.exp(min(700.0, no - yes)))
    return belief


@dataclass
class SpanClassifier:
    """Log-odds: of each kind, and of each (kind, feature) as `kind|feature`."""

    prior: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        """c: one of candidates(). Features not met in training weigh nothing."""
        if not self.prior:
            return F.lit(False)
        prior = F.create_map(*[F.lit(x) for pair in sorted(self.prior.items()) for x in pair])
        if not self.weight:
            return F.coalesce(F.element_at(prior, c["kind"]), F.lit(-1.0)) > 0
        weight = F.create_map(*[F.lit(x) for pair in sorted(self.weight.items()) for x in pair])
        total = F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(weight, F.concat(c["kind"], F.lit("|"), f)), F.lit(0.0)))
        return F.coalesce(F.element_at(prior, c["kind"]), F.lit(-1e9)) + total > 0


def train(found: DataFrame, column: str = "candidates") -> SpanClassifier:
    """found: a stored table with the column of candidates()."""
    one = found.select(F.explode(column).alias("c"))
    counts = one.groupBy("c.kind", "c.votes").count().collect()  # at most 3 x 81 rows
    belief = {k: estimate({r["votes"]: r["count"] for r in counts if r["kind"] == k}) for k in ADDED_KINDS}
    known = {f"{k}|{p}": b for k, own in belief.items() for p, b in own.items()}
    if not known:
        return SpanClassifier()
    told = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.concat("c.kind", F.lit("|"), "c.votes"))
    sums = one.select("c.kind", told.alias("p"), F.explode(F.array_append("c.features", F.lit("all"))).alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    model, totals, kinds_of = SpanClassifier(), {}, {}
    for r in sums:
        if r["feature"] == "all":
            totals[r["kind"]] = (r["yes"], r["no"])
            model.prior[r["kind"]] = math.log((r["yes"] + 1) / (r["no"] + 1))
        else:
            kinds_of.setdefault((r["kind"], r["feature"].split(":")[0]), []).append(r)
    for (kind, _), rows in kinds_of.items():
        yes, no = totals[kind]
        for r in rows:
            model.weight[f"{kind}|{r['feature']}"] = math.log((r["yes"] + 1) / (yes + len(rows))) - math.log((r["no"] + 1) / (no + len(rows)))
    return model


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def apart(spans: Column, taken: Column) -> Column:
    """Those of spans (start, end) that overlap none of taken. Both are put in one order of starts; a span is free if what
    is taken before it ends by its start, and what is taken after it starts by its end."""
    far = (1 << 31) - 1
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"))
    mixed = F.array_sort(F.concat(F.transform(spans, mark(True)), F.transform(taken, mark(False))))

    def free(m: Column) -> Column:
        ends = running(F.transform(m, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.greatest, 0)
        starts = running(F.reverse(F.transform(m, lambda s: F.when(s["own"], F.lit(far)).otherwise(s["start"]))), F.least, far)
        kept = F.zip_with(m, F.arrays_zip(ends.alias("ends"), F.reverse(starts).alias("starts")), lambda s, near: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["own"] & (near["ends"] <= s["start"]) & (near["starts"] >= s["end"])).alias("free")))
        return F.transform(F.filter(kept, lambda s: s["free"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(_PLACE)

    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), let(mixed, free)).otherwise(spans)


def with_chosen(df: DataFrame, base: dict[str, Column], proposed: Column, model: SpanClassifier, spans: str, more: str) -> DataFrame:
    """Add the columns spans (the base spans) and more (accepted further spans), each of (kind, start, end) by kind, then
    start. A projection per step, since Spark's analyzer resolves nested lambdas a level at a time and bounds its rounds."""
    names = [*df.columns, spans, more]
    fits, taken, own = spare(names, "fits"), spare(names, "taken"), spare(names, "own")
    place = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))

    def pick(kind: str) -> Callable[[Column], Column]:
        return lambda c: c["kind"] == kind

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    listed = F.concat(*[_listed(k, base[k]) for k in BASE_KINDS])
    df = df.withColumns({spans: listed, fits: F.filter(proposed, lambda c: model.accepts(c)), more: none})
    df = df.withColumn(taken, F.transform(spans, place))
    for kind in ADDED_KINDS:
        # A kind's free spans come to what the next kinds must keep clear of.
        df = df.withColumn(own, apart(F.transform(F.filter(fits, pick(kind)), place), F.col(taken)))
        df = df.withColumns({taken: F.concat(taken, own), more: F.concat(more, _listed(kind, F.col(own)))})
    return df.drop(fits, taken, own)


def _found(text: str) -> list[Column]:
    """A column per base kind, with places only, and candidates."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = {k: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k, s in base_spans(body).items()}
    return [*[s.alias(k) for k, s in slim.items()], candidates(body).alias("candidates")]


def extract(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored table of what the texts hold: the kept columns, a column per base kind, and candidates."""
    return stored(df.select(*keep, *_found(text)), "pii-spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame) -> DataFrame:
    """Train on df's documents and report on each."""
    found = extract(df)
    judged = with_chosen(found, {k: F.col(k) for k in BASE_KINDS}, F.col("candidates"), train(found), "base", "more")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return judged.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "more")).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """text with each span (start, end, kind; in order of starts) replaced by its kind. A span that starts inside an
    earlier one is no replacement of its own; what it covers beyond goes too. Cut in runs of spans: each run's piece of
    the text is cut out first, and its spans within that."""
    state = "struct<at:int,out:array<string>>"

    def run(part: Column, first: Column) -> Column:
        """The pieces of the text from first up to the end of the run's spans, where first is what is covered so far."""
        last = F.array_max(F.transform(part, lambda s: s["end"]))

        def cut(piece: Column) -> Column:
            begin = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

            def step(acc: Column, s: Column) -> Column:
                gap = F.substr(piece, acc["at"] - first + 1, s["start"] - acc["at"])
                added = F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
                inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
                return F.when(s["start"] < acc["at"], inside).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], added).alias("out"))).cast(state)

            return F.aggregate(part, begin, step, lambda acc: F.array_join(acc["out"], ""))

        return let(F.substr(text, first + 1, F.greatest(last - first, F.lit(0))), cut)

    def joined(own: Column) -> Column:
        covered = running(F.transform(own, lambda s: s["end"]), F.greatest, 0)

        def pieces(ends: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _RUN).cast("int")), lambda at: let(F.when(at > 0, F.get(ends, at * _RUN - 1)).otherwise(F.lit(0)), lambda first: run(F.slice(own, at * _RUN + 1, F.lit(_RUN)), first)))
            return F.concat(F.array_join(runs, ""), F.substr(text, F.element_at(ends, -1) + 1, F.length(text)))

        return let(covered, pieces)

    return let(spans, joined)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span, base and further, replaced by its kind in brackets. Null texts stay null. The texts are searched
    once: what they hold is stored beside them, and the model and the cuts are made from that."""
    hidden, base, more = (spare(df.columns, name) for name in ("pii", "base", "more"))
    found = stored(df.withColumn(hidden, F.struct(*_found(text))), "pii-spans")
    inner = found.select(F.col(hidden)["candidates"].alias("candidates"))
    judged = with_chosen(found, {k: F.col(hidden)[k] for k in BASE_KINDS}, F.col(hidden)["candidates"], train(inner), base, more)
    ordered = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    judged = judged.withColumn(more, ordered)
    new = let(F.col(more), lambda spans: F.when(F.size(spans) > 0, _without(F.col(text), spans)).otherwise(F.col(text)))
    return judged.select(*[F.when(F.col(text).isNotNull(), new).alias(c) if c == text else F.col(c) for c in df.columns])
