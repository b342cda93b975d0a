"""Secret scans: three fixed patterns, and two character Markov models, in DataFrame operations only.

The first model is trained on strings that the patterns label as secrets, the second on all other tokens
of a sample of texts. A token is a secret where the log-likelihood ratio of the two exceeds a threshold.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import sampled, stage

SAMPLE = 20_000  # secrets one model is trained on, and texts the other is, about: those of the smallest hashes
RATIO = 18.4  # log-likelihood ratio of a secret, at least: one in 10**8 tokens is a secret beforehand
SMOOTHING = 4.0  # weight of the characters' own frequencies in every transition's
NOISE = 0.01  # share of ordinary transitions that may be any: bounds what one transition adds to a ratio
KINDS = ("assign", "access", "hex", "markov")

#: Fixed patterns of the contract.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

_TOKENS = "[A-Za-z0-9+/_=-]"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_STATES = 128  # transitions are numbered by ASCII codes


def _spans(text: Column, pattern: str, kind: int, only: Column | None = None) -> Column:
    """Array of (start, kind, end, match) of the leftmost matches, or of those in ``only``: the texts between them give
    the places."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, lambda g: F.char_length(g)).alias("gap"), value.alias("m"))
    return F.filter(
        F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>").alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + F.coalesce(F.char_length(s["m"]), F.lit(0))).alias("at"),
                F.when(
                    s["m"].isNotNull() if only is None else F.array_contains(only, s["m"]),
                    F.concat(
                        a["out"],
                        F.array(
                            F.struct(
                                (a["at"] + s["gap"]).alias("start"),
                                F.lit(kind).alias("kind"),
                                (a["at"] + s["gap"] + F.char_length(s["m"])).alias("end"),
                                s["m"].alias("m"),
                            )
                        ),
                    ),
                )
                .otherwise(a["out"])
                .alias("out"),
            ),
        )["out"],
        lambda s: s["m"].isNotNull(),
    )


_NONE = "array<struct<start:int,kind:int,end:int,m:string>>"


def _only_where(text: Column, pattern: str, spans: Column) -> Column:
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_NONE))


def _assign_value(match: Column) -> Column:
    return F.regexp_extract(match, "^" + ASSIGN + "$", 2)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, m) of the three fixed patterns, in code points, end exclusive."""
    assign = F.filter(
        _only_where(text, ASSIGN, _spans(text, ASSIGN, 0)),
        lambda s: F.char_length(_assign_value(s["m"])) >= ASSIGN_VALUE,
    )
    access = _only_where(text, ACCESS, _spans(text, ACCESS, 1))
    hexes = _only_where(text, HEX, _spans(text, HEX, 2))
    return F.array_sort(F.concat(assign, access, hexes))


def _pairs(token: Column) -> Column:
    """Transition numbers of an ASCII string: code of a character times the states, plus that of the next."""
    codes = F.transform(F.split(token, ""), F.ascii)
    steps = F.char_length(token) - 1
    return F.zip_with(F.slice(codes, F.lit(1), steps), F.slice(codes, F.lit(2), steps), lambda a, b: a * _STATES + b)


def _without_secrets(text: Column) -> Column:
    """Texts without what the fixed patterns label: keys of assignments stay, their values go."""
    for pattern, rest in ((ASSIGN[:-2] + f"{{{ASSIGN_VALUE},}})", "$1 "), (ACCESS, " "), (HEX, " ")):
        text = F.regexp_replace(text, pattern, rest)
    return text


def _counts(tokens: DataFrame, texts: int) -> DataFrame:
    """(pair, n) of the transitions of ``tokens(token, key)`` that at least so many (1 or 2) different keys hold."""
    ends = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    counts = (
        tokens.filter(F.char_length("token") > 1)
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .select(F.explode(_pairs(F.col("token"))).alias("pair"), "n", "lo", "hi")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"), *ends)
    )
    return (counts if texts < 2 else counts.filter("lo <> hi")).select("pair", "n")


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of every transition (secret to ordinary), by transition number.

    Secret are what the fixed patterns match in any text (the value of an assignment, an access key behind
    its first four characters, a hexadecimal run): about ``sample`` different strings, all if there are fewer. Ordinary are
    all other tokens, digits and signs included, of about ``sample`` different texts; a transition that one
    text alone holds does not count there, as a secret's own text may not make it ordinary. Transitions are smoothed by the characters'
    frequencies, ordinary ones by ``NOISE`` besides. Without either kind nothing can be judged: a warning is given, and all ratios are 0.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("key"))
    value = F.transform(
        "found",
        lambda s: F.when(s["kind"] == 0, _assign_value(s["m"])).when(s["kind"] == 1, F.substring(s["m"], F.lit(5), F.char_length(s["m"]))).otherwise(s["m"]),
    )
    labelled = docs.select(base_spans(text).alias("found")).filter(F.size("found") > 0).select(F.explode(value).alias("token"))
    labelled = stage(labelled.distinct().withColumn("key", F.xxhash64("token")), "secret-strings")
    # A text counts once, however often it is repeated.
    some = sampled(keyed, "key", sample).groupBy("key").agg(F.min("text").alias("text"))
    plain = some.select(
        "key", F.explode(F.regexp_extract_all(_without_secrets(F.col("text")), F.lit(_TOKENS + "{2,}"), F.lit(0))).alias("token")
    )
    n = [[0.0] * (_STATES * _STATES) for _ in range(2)]
    for label, part, texts in ((1, sampled(labelled, "key", sample), 1), (0, plain, 2)):
        for r in _counts(part, texts).collect():  # at most one value a transition
            n[label][r["pair"]] = float(r["n"])
    if not sum(n[0]) or not sum(n[1]):
        kind = "secrets that the fixed patterns match" if sum(n[0]) else "ordinary tokens"
        warnings.warn(f"no {kind} to train on: only the fixed patterns are scanned for", stacklevel=2)
        return [0.0] * (_STATES * _STATES)
    letters = [ord(c) for c in _ALPHABET]
    logs = []
    for k, noise in ((0, NOISE), (1, 0.0)):
        row = {a: sum(n[k][a * _STATES : (a + 1) * _STATES]) for a in letters}
        column = {b: sum(n[k][b::_STATES]) for b in letters}
        total = sum(column.values())
        own = {b: (column[b] + 0.5) / (total + 0.5 * len(letters)) for b in letters}
        logs.append(
            {
                a * _STATES + b: math.log(
                    (1 - noise) * (n[k][a * _STATES + b] + SMOOTHING * own[b]) / (row[a] + SMOOTHING) + noise / len(letters)
                )
                for a in letters
                for b in letters
            }
        )
    out = [0.0] * (_STATES * _STATES)
    for p in logs[0]:
        out[p] = logs[1][p] - logs[0][p]
    return out


def least_length(ratios: list[float]) -> int | None:
    """Characters of the shortest token that can reach ``RATIO``, None if none can."""
    most = max(ratios)
    return 1 + math.ceil(RATIO / most) if most > 0 else None


def find_secrets(docs: DataFrame, ratios: list[float], name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: array of (start, kind, end, m), by start and kind. Kind 3 is the model's:
    maximal tokens whose summed ratio reaches ``RATIO`` and that no fixed pattern's span overlaps. Every token is judged that is long enough
    to reach it at all. NULL texts have no spans."""
    text = F.coalesce("text", F.lit(""))
    least = least_length(ratios)
    if least is None:
        return docs.withColumn(name, base_spans(text))
    table = F.array(*[F.lit(x) for x in ratios])
    model = docs.sparkSession.range(1, numPartitions=1).select(table.alias("_ratios"))
    pattern = f"{_TOKENS}{{{least},}}"
    # Each different token of a text is judged once; places are looked for where one is a secret.
    judged = F.filter(
        F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        lambda t: F.aggregate(_pairs(t), F.lit(0.0), lambda s, p: s + F.get("_ratios", p)) >= RATIO,
    )

    def placed(secret: Column, base: Column) -> Column:
        tokens = F.when(F.size(secret) > 0, _spans(text, pattern, 3, secret)).otherwise(F.array().cast(_NONE))
        free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.array_sort(F.concat(base, free))

    # As a lambda's argument both are computed once a text.
    both = F.array(F.struct(judged.alias("secret"), base_spans(text).alias("base")))
    found = F.element_at(F.transform(both, lambda x: placed(x["secret"], x["base"])), 1)
    return docs.join(F.broadcast(model)).withColumn(name, found).drop("_ratios")


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    )


def secret_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Trains on ``docs`` and scans every whole text. ``spans`` lists kind:start:end by start, then kind;
    ``base_sha256`` hashes the list of the three fixed kinds. Texts without spans, NULL ones included,
    have empty lists. Repeated rows are scanned one by one; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs, train(docs, sample)).select("doc_id", "found")

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, sample: int = SAMPLE, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping spans by one), and
    ``n_chars``, where there is such a column, counted anew for changed texts. No row is dropped."""
    names = docs.columns
    ratios = train(docs.select("doc_id", "text"), sample)
    rows = docs.select(F.struct("*").alias("row"), "text")  # so that no column of the input clashes
    found = find_secrets(rows, ratios)
    text = F.col("text")
    step = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    done = found.select("row", (F.size("found") > 0).alias("hit"), F.when(F.size("found") > 0, step).otherwise(text).alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("hit"), F.char_length("new").cast(kind)).otherwise(F.col("row.n_chars"))
    return done.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])
