"""Personal data by weak supervision, in DataFrame operations only.

Base spans are fixed patterns with checks (email, ip, card, phone).  Further spans,
of kinds `number` and `secret`, are candidates of wide patterns on which labelers
vote: regular expressions on the span's shape, gazetteers of key words, the words before it, a
checksum.  A labeler says yes, no or nothing.  Candidates are grouped by their
votes, of which there are 3^5 at most for each kind, and only these counts reach the
driver.  Expectation-maximisation estimates each labeler's reliability from how they agree,
as if votes were independent given the truth; the posteriors then are the soft labels of a
logistic regression on votes and pairs of votes, the final span classifier.  It is a sum
of weights, so it is applied as a column expression.  Added spans never overlap base ones or each other.

The base patterns match the same spans as the plain ones in BASE; they only start
where a run of characters starts and never step back, so no text makes them slow or deep.
Positions are code points, ends exclusive.  Null text counts as empty and has no
spans.  Repeated rows are treated alike, null doc_id is kept, empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns whose leftmost matches are wanted.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# The same matches without stepping back.  `card` leaves out those too short to count.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

# Candidates of the method.  Neither has a longest length; all repeats are possessive.
_CARD = r"[0-9]{4}(?:[\x20-][0-9]{4}){3}"
# Complete numbers, which end a candidate however many follow each other.
_SHAPE = (
    r"(?<![A-Za-z0-9+])(?<![0-9][.-])(?:"
    r"(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}"
    # Groups of four that are no card by themselves may be part of a longer number.
    rf"|(?:(?<![0-9][\x20-])|(?<=\G\x20)){_CARD}(?=\x20{_CARD}(?![0-9])|(?![\x20-][0-9]))"
    r")(?![A-Za-z0-9])(?![.-][0-9])"
)
_NUMBER = (
    rf"{_SHAPE}|(?<![A-Za-z0-9+(])[+(]{{0,2}}(?!{_SHAPE})[0-9]++(?![A-Za-z])"
    rf"(?:(?!{_SHAPE})(?:[\x20().-]|[0-9]++(?![A-Za-z])))*+"
)
LEAST_NUMBER = 6  # characters
_SECRET_KEY = r"[\p{L}\p{N}_-]{2,}+[\"']?\x20?[=:]\x20?[\"']?"
_SECRET = rf"(?<![\p{{L}}\p{{N}}_-])(?=[\p{{N}}_-]*+\p{{L}}){_SECRET_KEY}[A-Za-z0-9+/_.-]{{6,}}+={{0,2}}+"
_VALUE = rf"^{_SECRET_KEY}(.*)$"

# Gazetteers.
SECRET_KEYS = "password passwd passphrase pwd secret token api_key apikey api-key access_key auth bearer credential credentials pin passwort kennwort contraseña clave"
PLAIN_KEYS = "http https note version page chapter fig figure table width height lang charset style class section time date"
NUMBER_WORDS = "phone tel telephone mobile call fax telefon handy anruf téléphone portable appel teléfono móvil llama ssn account iban konto cuenta compte card karte carte tarjeta passport"

CONTEXT = 24  # code points before a candidate that the context labeler reads
ROUNDS = 40  # of expectation-maximisation
KEEP_AT = 0.5


_SPANS = "array<struct<start: int, end: int, value: string, before: string>>"

# Matches that are placed together; a list is copied as often as it grows, so long ones are built of such runs.
_RUN = 256


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of a pattern's leftmost matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.filter(
        F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("h"), g.alias("g"))),
        lambda x: x.h.isNotNull(),
    )
    nothing = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state.at + F.char_length(x.g)
        # Matches in a row share what stands before the first; null if that is in an earlier run.
        before = F.when(x.g.rlike(r"^[\x20().-]*$"), state.before).otherwise(F.right(x.g, F.lit(CONTEXT)))
        span = F.struct(
            start.alias("start"),
            (start + F.char_length(x.h)).alias("end"),
            x.h.alias("value"),
            before.alias("before"),
        )
        return F.struct(
            (start + F.char_length(x.h)).alias("at"), before.alias("before"), F.array_append(state.out, span).alias("out")
        )

    def placed(state: Column, run: Column) -> Column:
        spans = F.transform(
            run.out,
            lambda s: F.struct(
                (state.at + s.start).alias("start"),
                (state.at + s.end).alias("end"),
                s.value.alias("value"),
                F.coalesce(s.before, state.before).alias("before"),
            ),
        )
        return F.struct(
            (state.at + run.at).alias("at"),
            F.coalesce(run.before, state.before).alias("before"),
            F.array_append(state.out, spans).alias("out"),
        )

    def empty(before: Column, out: Column) -> Column:
        return F.struct(F.lit(0).alias("at"), before.cast("string").alias("before"), out.alias("out"))

    firsts = F.filter(F.sequence(F.lit(1), F.size(both) + 1, F.lit(_RUN)), lambda i: i <= F.size(both))
    runs = F.transform(firsts, lambda i: F.aggregate(F.slice(both, i, _RUN), empty(F.lit(None), nothing), step))
    none = F.array().cast(f"array<{_SPANS}>")
    return F.aggregate(runs, empty(F.lit(""), none), placed, lambda s: F.flatten(s.out))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value, before) of one base kind."""
    spans = F.filter(found(text, _FAST[kind]), lambda s: _valid(kind, s.value))
    # Most texts lack the character that a match needs.
    if kind in _NEEDS:
        spans = F.when(F.contains(text, F.lit(_NEEDS[kind])), spans)
    else:
        spans = F.when(text.rlike("[0-9]"), spans)
    return F.coalesce(spans, F.array().cast(_SPANS))


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    if no is not None:
        vote = vote.when(no, -1)
    return vote.otherwise(0)


def _words(words: str) -> str:
    return "|".join(words.split())


def _secret_votes(value: Column, hit: Column) -> list[Column]:
    key = F.lower(F.regexp_extract(hit, r"^([\p{L}\p{N}_-]+)", 1))
    n = F.length(value)
    digits = F.length(_digits(value))
    return [
        _vote(value.rlike("^(?:[0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{24,}={0,2})$"), value.rlike("^[A-Za-z.]*$|^[0-9.]{1,11}$")),
        _vote(key.rlike(rf"(?:^|[_-])(?:{_words(SECRET_KEYS)})[0-9]*$"), key.rlike(f"^(?:{_words(PLAIN_KEYS)})$")),
        _vote(hit.rlike(r"^[\p{L}\p{N}_-]+[\"']?\x20?="), hit.rlike(r"^\p{L}+:\x20")),
        _vote(hit.rlike("[\"']")),
        _vote((digits * 10 >= n) & (digits * 10 <= n * 9) & (n >= 8), digits == 0),
    ]


def _number_votes(value: Column, before: Column) -> list[Column]:
    digits = _digits(value)
    n = F.length(digits)
    return [
        _vote(value.rlike(r"^\+[0-9]") & n.between(9, 15), n > 19),
        _vote(value.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$"), value.rlike("^[0-9]+$")),
        _vote(F.lower(before).rlike(rf"\b(?:{_words(NUMBER_WORDS)})\b[^0-9]*$")),
        _vote(n.between(13, 19) & luhn(digits), n.between(13, 19) | (n < 9)),
        _vote(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), value.rlike(r"^[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}$")),
    ]


VOTES = 5
_CANDIDATES = "array<struct<kind: string, start: int, end: int, votes: array<int>>>"


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, votes)."""

    def secret(s: Column) -> Column:
        value = F.regexp_extract(s.value, _VALUE, 1)
        return F.struct(
            F.lit("secret").alias("kind"),
            (s.end - F.char_length(value)).alias("start"),
            s.end.alias("end"),
            F.array(*_secret_votes(value, s.value)).alias("votes"),
        )

    def number(s: Column) -> Column:
        # The pattern may end in separators; the span may not.
        value = F.regexp_replace(s.value, r"[\x20().-]+$", "")
        return F.struct(
            F.lit("number").alias("kind"),
            s.start.alias("start"),
            (s.start + F.char_length(value)).alias("end"),
            F.array(*_number_votes(value, s.before)).alias("votes"),
        )

    secrets = F.when(text.rlike("[=:]"), F.transform(found(text, _SECRET), secret))
    long = F.filter(found(text, _NUMBER), lambda s: F.char_length(s.value) >= LEAST_NUMBER)
    numbers = F.when(text.rlike("[0-9]"), F.transform(long, number))
    none = F.array().cast(_CANDIDATES)
    return F.concat(F.coalesce(secrets.cast(_CANDIDATES), none), F.coalesce(numbers.cast(_CANDIDATES), none))


def vote_counts(docs: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How often each pattern of votes occurs: at most 2 * 3^5 rows."""
    rows = (
        docs.select(F.explode(candidates(F.col("text"))).alias("c"))
        .groupBy("c.kind", "c.votes")
        .count()
        .collect()
    )
    return sorted((r.kind, tuple(r.votes), r["count"]) for r in rows)


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior that a pattern of votes marks a true span, by expectation-maximisation.

    Starts from the majority of votes; a candidate with no vote for it is taken as false.
    """
    post = {}
    for votes, _ in counts:
        lead = sum(votes)
        post[votes] = 0.95 if lead >= 2 else 0.7 if lead == 1 else 0.05
    for _ in range(ROUNDS):
        mass = {y: 1.0 for y in (0, 1)}
        seen = {(j, v, y): 0.5 for j in range(VOTES) for v in (-1, 0, 1) for y in (0, 1)}
        for votes, n in counts:
            for y in (0, 1):
                w = n * (post[votes] if y else 1 - post[votes])
                mass[y] += w
                for j, v in enumerate(votes):
                    seen[j, v, y] += w
        total = mass[0] + mass[1]
        new = {}
        for votes, _ in counts:
            logs = [
                math.log(mass[y] / total)
                + sum(math.log(seen[j, v, y] / (mass[y] + 1.5)) for j, v in enumerate(votes))
                for y in (0, 1)
            ]
            new[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, logs[0] - logs[1]))))
            # A labeler's yes is never evidence against: without any, it is no span.
            if max(votes) < 1:
                new[votes] = min(new[votes], 0.05)
        post = new
    return post


_PAIRS = list(combinations(range(VOTES), 2))


def _features(votes) -> list:
    """1, each vote, and whether two labelers say yes together."""
    return [1, *votes, *[(votes[i] == 1) & (votes[j] == 1) for i, j in _PAIRS]]


def classifier(counts: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """Weights of a logistic regression whose labels are the posteriors."""
    post = reliabilities(counts)
    rows = [([float(x) for x in _features(votes)], post[votes], math.log1p(n)) for votes, n in counts]
    weights = [0.0] * (1 + VOTES + len(_PAIRS))
    total = sum(mass for _, _, mass in rows) or 1.0
    for step in range(1500):
        gradient = [1e-4 * w for w in weights]
        for x, y, mass in rows:
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            error = mass / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - y)
            for i, v in enumerate(x):
                gradient[i] += error * v
        weights = [w - 2.0 / (1 + step / 500) * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def train(docs: DataFrame) -> dict[str, list[float]]:
    """The final classifier's weights for each kind that has candidates."""
    counts = vote_counts(docs)
    return {
        kind: classifier([(votes, n) for k, votes, n in counts if k == kind])
        for kind in sorted({k for k, _, _ in counts})
    }


def _accepted(candidate: Column, model: dict[str, list[float]]) -> Column:
    level = math.log(KEEP_AT / (1 - KEEP_AT))
    verdict = F.lit(False)
    for kind, weights in model.items():
        votes = [candidate.votes[j] for j in range(VOTES)]
        score = F.lit(weights[0])
        for w, feature in zip(weights[1:], _features(votes)[1:], strict=True):
            score = score + F.lit(w) * feature.cast("double")
        verdict = F.when(candidate.kind == kind, score > level).otherwise(verdict)
    return verdict


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s.start.cast("string"), s.end.cast("string")))


def _is_kind(kind: str):
    return lambda candidate: candidate.kind == kind


def find(docs: DataFrame, model: dict[str, list[float]]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select("doc_id", text.alias("text"))
    staged = staged.select(
        "doc_id",
        *[base_spans(F.col("text"), kind).alias(kind) for kind in BASE],
        candidates(F.col("text")).alias("candidates"),
    )
    held = F.concat(*BASE)
    staged = staged.withColumn("held", held)
    chosen = F.filter("candidates", lambda c: _accepted(c, model))
    # Candidates of different kinds may overlap: the first in the list stays.
    free = F.aggregate(
        chosen,
        F.array().cast(_CANDIDATES),
        lambda kept, c: F.when(
            F.exists(kept, lambda k: (k.start < c.end) & (c.start < k.end)), kept
        ).otherwise(F.array_append(kept, c)),
    )
    clear = F.filter(
        free, lambda c: ~F.exists("held", lambda h: (h.start < c.end) & (c.start < h.end))
    )
    staged = staged.withColumn("added", F.when(F.size("candidates") > 0, clear).otherwise(F.array().cast(_CANDIDATES)))
    base = F.concat(*[_joined(kind, F.col(kind)) for kind in BASE])
    more = [
        _joined(kind, F.array_sort(F.filter("added", _is_kind(kind))))
        for kind in ("number", "secret")
    ]
    return staged.select(
        F.col("doc_id"),
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, *more), ",").alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span of a `spans` string replaced by its kind in brackets."""
    parts = F.transform(
        F.filter(F.split(spans, ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.split(s, ":")[2].cast("int").alias("end"),
            F.split(s, ":")[0].alias("kind"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state.at + 1, F.greatest(s.start - state.at, F.lit(0)))
        mark = F.when(s.start >= state.at, F.concat(F.lit("["), s.kind, F.lit("]"))).otherwise("")
        return F.struct(F.greatest(state.at, s.end).alias("at"), F.concat(state.out, gap, mark).alias("out"))

    rest = F.char_length(text)
    return F.aggregate(
        F.array_sort(parts), start, step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, rest))
    )
