"""Personal data by weak supervision, in built-in functions only.

Base spans come from the four patterns of the contract. Further candidates are
runs of letters and digits with at least one digit. Labelers (patterns, a
gazetteer of cue words, the context) vote on each: yes, no or no vote. An
expectation-maximisation over the counts of vote patterns, at most ``3**6`` of
them, estimates how reliable each labeler is and how likely a pattern is
personal data. These likelihoods, summed per combination of ten binary
features (at most ``2**10``), train a logistic span classifier, which decides
on the candidates; those it accepts and no base span overlaps are added as
``secret`` or ``number``.

Only the two small count tables reach the driver; their size is bounded by the
number of labelers and features, whatever the size of the corpus.

Nulls and edges: null and empty texts have no spans; positions are code
points; texts are searched whole; rows are independent, so repeated rows
repeat; an empty table gives an empty result; without candidates the
classifier accepts none; further columns are ignored.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_text, materialize

# The base patterns, written so that no start inside a run is tried twice.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@"
         r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+"
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
PART_TO_255 = "^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

CUES = ("token key secret password passwd pin card account iban phone tel call ssn passport visa "
        "clave llave cuenta tarjeta jeton carte compte konto karte kennwort").split()
BENIGN = "version copyright license rfc isbn figure page http https www".split()
CONTEXT_CHARS = 24
LABELERS = ["digits", "hex", "checksum", "cue", "benign", "assigned"]
ABSTAIN = 2
ROUNDS = 40


def _cut(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """Matches, and the text around them, of a pattern; nothing where ``when`` does not hold."""
    nothing = F.array().cast("array<string>")
    return (F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing),
            F.when(when, F.split(text, pattern, -1)).otherwise(nothing))


def _spans(matches: Column, around: Column) -> Column:
    """Array of (start, end, match, before, after); code points, end exclusive."""
    steps = F.zip_with(matches, F.slice(around, F.lit(1), F.size(matches)),
                       lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["pos"] + x["gap"] + x["len"]).alias("pos"),
                              F.concat(a["out"], F.array(a["pos"] + x["gap"])).alias("out")),
        lambda a: a["out"],
    )
    tails = F.transform(around, lambda g: F.substring(g, F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS)))
    return F.transform(
        F.arrays_zip(matches.alias("m"), starts.alias("s"), F.slice(tails, F.lit(1), F.size(matches)).alias("b")),
        lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"),
                           x["m"].alias("match"), x["b"].alias("before")))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(
            i % 2 == 0, F.element_at(doubled, F.substring(backwards, i, F.lit(1)).cast("int") + 1)
        ).otherwise(F.substring(backwards, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: p.rlike(PART_TO_255))
    n = F.length(digits_of(match))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _words(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def _candidate(x: Column) -> Column:
    """Votes and features of a candidate."""
    m, before = x["match"], x["before"]
    n = F.length(m)
    numeric = ~m.rlike("[A-Za-z]")
    hexadecimal = m.rlike("^[0-9a-fA-F]{32,}$") & ~numeric
    checked = F.when(numeric & n.between(13, 19), luhn(m))
    cue, benign = before.rlike(_words(CUES)), before.rlike(_words(BENIGN))
    assigned = before.rlike(r"""[=:]\s*["']?$""")
    abstain = F.lit(ABSTAIN)
    votes = [
        F.when(numeric, F.when(n.between(13, 19), 1).otherwise(0)).otherwise(abstain),
        F.when(hexadecimal, 1).when(~numeric & (n < 16), 0).otherwise(abstain),
        F.when(checked, 1).when(~checked, 0).otherwise(abstain),
        F.when(cue, 1).otherwise(abstain),
        F.when(benign, 0).otherwise(abstain),
        F.when(assigned, 1).otherwise(abstain),
    ]
    features = [numeric, hexadecimal, n >= 12, n >= 16, n >= 24, n >= 32, F.coalesce(checked, F.lit(False)), cue,
                benign, assigned]
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), numeric.alias("numeric"),
        F.concat(*[v.cast("string") for v in votes]).alias("votes"),
        F.concat(*[f.cast("int").cast("string") for f in features]).alias("features"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end), candidates (start, end, numeric, votes, features) of every row."""
    text = F.col("text")
    patterns = {"email": (EMAIL, text.contains("@")), "ip": (IP, text.contains(".")), "card": (CARD, F.lit(True)),
                "phone": (PHONE, text.contains("+")), "other": (CANDIDATE, F.lit(True))}
    cut = id_text(docs)
    cut = cut.select("doc_id", *[c.alias(f"{name}_{kind}") for kind, (p, when) in patterns.items()
                                 for name, c in zip(("m", "g"), _cut(text, p, when))])
    spans = cut.select("doc_id", *[_spans(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(k) for k in patterns])

    def base(number: int, kind: str) -> Column:
        return F.transform(
            F.filter(F.col(kind), lambda x: _valid(kind, x["match"])),
            lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return spans.select(
        "doc_id", F.concat(*[base(i, k) for i, k in enumerate(KINDS[:4])]).alias("base"),
        F.transform("other", _candidate).alias("candidates"))


def estimate_reliability(counts: dict[str, int]) -> dict[str, float]:
    """Likelihood of personal data per vote pattern, by expectation-maximisation.

    Every labeler has a probability of each of its three answers for either truth; answers are
    independent given the truth. The start is the share of yes among the votes cast.
    """
    def start(votes: str) -> float:
        cast = [v for v in votes if v != str(ABSTAIN)]
        return (cast.count("1") + 0.5) / (len(cast) + 1)

    belief = {v: start(v) for v in counts}
    total = sum(counts.values())
    for _ in range(ROUNDS if total else 0):
        yes = sum(n * belief[v] for v, n in counts.items())
        prior = (yes + 1) / (total + 2)
        answers: list[tuple[dict[str, float], dict[str, float]]] = []
        for i in range(len(LABELERS)):
            of_yes, of_no = dict.fromkeys("012", 1.0), dict.fromkeys("012", 1.0)
            for v, n in counts.items():
                of_yes[v[i]] += n * belief[v]
                of_no[v[i]] += n * (1 - belief[v])
            answers.append(tuple({k: x / sum(d.values()) for k, x in d.items()} for d in (of_yes, of_no)))
        for v in belief:
            a, b = prior, 1 - prior
            for i, (of_yes, of_no) in enumerate(answers):
                a, b = a * of_yes[v[i]], b * of_no[v[i]]
            belief[v] = a / (a + b)
    return belief


def train_classifier(rows: list[tuple[str, float, int]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights (the last is the intercept) from (features, summed likelihood, count)."""
    total = sum(n for _, _, n in rows)
    width = len(rows[0][0]) if rows else 0
    weights = [0.0] * width + [0.0 if rows else -30.0]
    parsed = [([int(c) for c in f] + [1], s / total, n / total) for f, s, n in rows]
    for _ in range(steps if rows else 0):
        slope = [0.0] * len(weights)
        for x, s, n in parsed:
            z = max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x))))
            error = s - n / (1 + exp(-z))
            for k, v in enumerate(x):
                slope[k] += error * v
        weights = [w + rate * (g - 1e-4 * w) for w, g in zip(weights, slope)]
    return weights


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end); kinds by their number in ``KINDS``."""
    found = materialize(find_spans(docs))
    votes = found.select(F.explode("candidates").alias("c")).groupBy(
        F.col("c.votes").alias("votes"), F.col("c.features").alias("features")).count()
    table = [(r.votes, r.features, r["count"]) for r in votes.collect()]  # at most 3**6 * 2**10 rows, in fact a few
    counts: dict[str, int] = {}
    for v, _, n in table:
        counts[v] = counts.get(v, 0) + n
    belief = estimate_reliability(counts)
    summed: dict[str, tuple[float, int]] = {}
    for v, f, n in table:
        s, m = summed.get(f, (0.0, 0))
        summed[f] = (s + n * belief[v], m + n)
    weights = train_classifier([(f, s, n) for f, (s, n) in sorted(summed.items())])
    return classify(found, weights)


def classify(found: DataFrame, weights: list[float]) -> DataFrame:
    def accepted(c: Column) -> Column:
        z = F.lit(float(weights[-1]))
        for i, w in enumerate(weights[:-1]):
            z = z + F.substring(c["features"], F.lit(i + 1), F.lit(1)).cast("double") * F.lit(float(w))
        clear = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return (z >= 0) & clear  # at least as likely as not

    chosen = F.transform(
        F.filter("candidates", accepted),
        lambda c: F.struct(F.when(c["numeric"], 5).otherwise(4).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(chosen).alias("added"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(number: int):
    return lambda b: b["kind"] == number


def report(spans: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.concat("base", "added")).alias("spans"))
