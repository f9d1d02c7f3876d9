"""Secret scan with a battery of randomness tests.

Three patterns give the base spans. Beyond them, every token of 20 or more characters of a key alphabet
is a candidate: its encoding is inferred, and tests of that encoding's alphabet ask whether the characters look
drawn at random: chi-squared uniformity over the alphabet and over its classes of characters, runs of classes,
and serial correlation. Fisher's method combines the tail probabilities.

A token that passes is not yet a secret: short names pass at times. What counts is how often ordinary tokens pass.
The battery therefore also runs over a fixed reference of ordinary tokens (names, paths, slugs, numbers, made
by rule); by length band and encoding, the share of them that look at least as random is a candidate's p-value under
the null hypothesis that it is ordinary. Per length band, Benjamini-Hochberg over all distinct candidates of the corpus keeps the
expected share of ordinary tokens among the reported ones at RATE. SQL functions only on the main path.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read_table
from .spans import listed, no_spans, normal_tail, overlaps, plain_text, with_spans

_KEY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = _KEY + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # the whole run, as long as AKIA[A-Z0-9]+ of 20 or more
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
#: Encodings in the order in which they are tried, with their alphabets.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Classes of characters: digits, frequent and other letters of either case, signs.
CLASSES = {"D": "0123456789", "a": "etaoinsrhl", "b": "bcdfgjkmpquvwxyz", "A": "ETAOINSRHL", "B": "BCDFGJKMPQUVWXYZ", "S": "+/-_"}
#: Alphabets by place; the last is for what mixes both base64 forms.
ALPHABETS = (*ENCODINGS.values(), ENCODINGS["base64"] + "-_")
#: Lower ends of the length bands; the rate of false discoveries; steps of a decade of the battery's p.
LENGTHS, RATE, STEPS = (20, 32, 48, 96), 0.01, 16
#: Ordinary tokens of each form and length band; the least a band and encoding needs for figures of its own.
REFERENCE, ENOUGH = 1000, 300
#: Shares of the reference between which its tail is taken to fall off; below the first it goes on falling at that rate.
TAIL = (0.005, 0.05)


def _by_encoding(x: Column, value) -> Column:
    """value(alphabet), a number, for the token's encoding."""
    return F.element_at(F.array(*(F.lit(float(value(a))) for a in ALPHABETS)), x["enc"] + 1)


def _share(alphabet: str, chars: str) -> float:
    return sum(c in chars for c in alphabet) / len(alphabet)


def _groups(alphabet: str, power: int) -> float:
    """Sum of powers of the shares of digits, either case and signs."""
    return sum(_share(alphabet, "".join(CLASSES[c] for c in g)) ** power for g in ("D", "ab", "AB", "S"))


def _upper_tail(chi: Column, df: Column) -> Column:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (df * 9))) / F.sqrt(2 / (df * 9))
    return F.when(z > 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)


def battery(candidates: Column) -> Column:
    """candidates (spans): each with band, enc, h (a hash of the token) and step, of the chance of so odd a token if it were random.

    Work is linear in a token's length: a pass for each character of the alphabet, and one over the values.
    """

    def judged(x: Column) -> Column:
        body = F.rtrim(x["m"], F.lit("="))
        enc = F.coalesce(*(F.when(body.rlike(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$"), F.lit(i)) for i, a in enumerate(ENCODINGS.values())), F.lit(len(ALPHABETS) - 1))
        kinds = F.translate(body, "".join(CLASSES.values()), "".join(k * len(c) for k, c in CLASSES.items()))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), body.alias("m"), kinds.alias("kinds"), F.length(body).cast("double").alias("n"), enc.alias("enc"))

    def values(x: Column) -> Column:
        alphabet = F.element_at(F.array(*map(F.lit, ALPHABETS)), x["enc"] + 1)
        chars = F.filter(F.split(x["m"], ""), lambda c: c != "")
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "m", "kinds", "n", "enc")), alphabet.alias("a"), F.transform(chars, lambda c: F.call_function("instr", alphabet, c).cast("double")).alias("v"))

    def moments(x: Column) -> Column:
        n = x["n"]
        held = lambda text, c: n - F.length(F.replace(text, c, F.lit("")))
        squares = F.aggregate(F.filter(F.split(x["a"], ""), lambda c: c != ""), F.lit(0.0), lambda t, c: t + F.pow(held(x["m"], c), F.lit(2.0)))
        k = _by_encoding(x, len)
        classes, cells = F.lit(0.0), _by_encoding(x, lambda a: sum(_share(a, c) > 0 for c in CLASSES.values()))
        for kind, chars in CLASSES.items():
            want = n * _by_encoding(x, lambda a: max(_share(a, chars), 1e-9))  # noqa: B023
            classes = classes + F.when(want > n * 1e-6, F.pow(held(x["kinds"], F.lit(kind)) - want, F.lit(2.0)) / want).otherwise(0.0)
        runs = F.regexp_count(x["kinds"], F.lit("D++|[ab]++|[AB]++|S++")).cast("double")
        mean = F.aggregate(x["v"], F.lit(0.0), lambda t, y: t + y) / n
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "n", "enc", "v")), F.xxhash64(x["m"]).alias("h"), k.alias("k"), (k / n * squares - n).alias("chi"), classes.alias("classes"), cells.alias("cells"), runs.alias("runs"), mean.alias("mean"))

    def serial(x: Column) -> Column:
        # one pass: the last deviation, the sums of squares and of products of neighbours
        def add(t: Column, y: Column) -> Column:
            d = y - x["mean"]
            return F.struct(d.alias("d"), (t["var"] + d * d).alias("var"), (t["cov"] + t["d"] * d).alias("cov"))

        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("var"), F.lit(0.0).alias("cov"))
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "n", "enc", "h", "k", "chi", "classes", "cells", "runs")), F.aggregate(x["v"], zero, add).alias("r"))

    def combined(x: Column) -> Column:
        n, s2, s3 = x["n"], _by_encoding(x, lambda a: _groups(a, 2)), _by_encoding(x, lambda a: _groups(a, 3))
        spread = (n - 1) * s2 * (1 - s2) + (n - 2) * 2 * (s3 - s2 * s2)
        tests = (
            _upper_tail(x["chi"], x["k"] - 1), _upper_tail(x["classes"], x["cells"] - 1),
            normal_tail((x["runs"] - 1 - (n - 1) * (1 - s2)) / F.sqrt(spread)),
            F.when(x["r"]["var"] > 0, normal_tail(x["r"]["cov"] / x["r"]["var"] * F.sqrt(n))).otherwise(F.lit(1e-300)),
        )
        half = F.lit(0.0)
        for p in tests:
            half = half - F.log(F.greatest(p, F.lit(1e-300)))
        p = F.exp(-half) * (half * half * half / 6 + half * half / 2 + half + 1)
        band = F.lit(0)
        for low in LENGTHS[1:]:
            band = band + (n >= low).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), band.alias("band"), x["enc"].alias("enc"), x["h"].alias("h"), _step(F.greatest(p, F.lit(1e-300))).alias("step"))

    for step in (judged, values, moments, serial, combined):
        candidates = F.transform(candidates, step)
    return candidates


def _step(p: Column) -> Column:
    """Steps of p, from 0, as random as can be."""
    return F.floor(-F.log10(F.least(p, F.lit(1.0))) * STEPS).cast("int")


#: Words of the reference tokens.
_WORDS = """user profile settings config model training checkpoint data loader index page image request response server client handler
service manager factory builder test result value string number list item order invoice payment account customer product category
search filter sort group count total average report export import upload download file folder path name title description comment
message notification email address phone country city street date time start end update create delete insert select table column
row cell header footer menu button link style color width height margin border layout grid view component module package library
version release build deploy branch commit merge review main java com org example internal public private static final class""".split()


def reference(each: int = REFERENCE, seed: int = 11) -> list[str]:
    """Ordinary tokens of eight forms, `each` of every form and length band; the same in every run."""
    rng = random.Random(seed)
    number = lambda: str(rng.choice([rng.randint(0, 9), rng.randint(10, 99), rng.randint(1990, 2030), rng.randint(100, 99_999)]))
    word = lambda: rng.choice(_WORDS) + rng.choice(["", "", "", "s"])

    def part(kind: int) -> str:
        odd = rng.random() < 0.2
        return [
            lambda: number() if odd else word().capitalize(), lambda: number() if odd else word(), lambda: (word().upper() if rng.random() < 0.9 else number()), lambda: word().capitalize() if odd else word(),
            lambda: word(), lambda: word().upper(), lambda: f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}", lambda: number() if odd else word().capitalize() if rng.random() < 0.4 else word(),
        ][kind]()

    joints = [[""], ["_", "-"], ["_"], ["/"], [""], [""], ["", "-", "_"], ["/", "-", "_"]]
    out = []
    for low, high in zip(LENGTHS, (*LENGTHS[1:], 2 * LENGTHS[-1])):
        for kind in range(len(joints)):
            for _ in range(each):
                joint, length, token = rng.choice(joints[kind]), rng.randint(low, high - 1), part(kind)
                while len(token) < length:
                    token += joint + part(kind)
                out.append(token if len(token) < high else token[:length])
    return out


def ordinary_steps(spark: SparkSession) -> dict[tuple[int, int], list[int]]:
    """The battery's steps of the reference tokens by band and encoding, ascending; (band, -1) has all of a band."""
    rows = spark.createDataFrame([(t,) for t in reference()], "t string").select(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.col("t").alias("m"))).alias("c"))
    out = defaultdict(list)
    for r in rows.select(battery(F.col("c"))[0].alias("x")).groupBy("x.band", "x.enc", "x.step").count().collect():  # by band, encoding and step
        for cell in ((r.band, r.enc), (r.band, -1)):
            out[cell] += [r.step] * r["count"]
    return {cell: sorted(steps) for cell, steps in out.items()}


def ordinary_share(known: list[int], step: int) -> float:
    """Share of the ordinary tokens (their steps, ascending) that look at least as random as `step` says. Below the
    least of them it falls off as between the two shares of TAIL, though in truth faster: so it's never too small."""
    n = len(known)
    if not n:
        return 1.0
    low, high = (known[int(n * share)] for share in TAIL)
    if step >= low or high <= low:
        return (1 + bisect_right(known, step)) / (1 + n)
    return TAIL[0] * (TAIL[0] / TAIL[1]) ** ((low - step) / (high - low))


def thresholds(judged: DataFrame, ordinary: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], int]:
    """judged: band, enc, step, h. For each band and encoding the last step at which a token is reported.

    Tokens that repeat count once, as copies tell nothing new. Counts by band, encoding and step are all that is
    gathered: a few thousand rows at most. A step's p-value is the share of ordinary tokens that look as random or more so. Of a band the largest p-value is taken at which
    Benjamini-Hochberg's bound holds over all its candidates.
    """
    bands: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)
    for r in judged.select("band", "enc", "step", "h").distinct().groupBy("band", "enc", "step").count().collect():
        known = ordinary.get((r.band, r.enc), [])
        known = known if len(known) >= ENOUGH else ordinary.get((r.band, -1), [])
        bands[r.band].append((ordinary_share(known, r.step), r.enc, r.step, r["count"]))
    limits: dict[tuple[int, int], int] = {}
    for band, cells in bands.items():
        total, upto, last = sum(c[3] for c in cells), 0, 0.0
        for i, (p, _, _, n) in enumerate(cells := sorted(cells)):
            upto += n
            if (i + 1 == len(cells) or cells[i + 1][0] > p) and p * total <= RATE * upto:
                last = p
        for p, enc, step, _ in cells:
            if p <= last:
                limits[band, enc] = max(step, limits.get((band, enc), 0))
    return limits


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, assign, access, hex, random: spans of each kind, one row per row.

    Null texts count as empty and have no spans; repeated rows repeat; an empty table stays empty. Whether
    a token is reported depends on all candidates of the table, not on its row alone. Other columns aren't read.
    """
    text = docs.select("doc_id", plain_text(F.col("text")).alias("t"))
    # most texts hold none of the words of assignments and no run as long as a token: one look each spares the patterns
    named = F.lit(False)
    for word in ("pass", "secret", "token", "key"):
        named = named | F.contains(F.lower("t"), F.lit(word))
    text = text.withColumn("_named", named).withColumn("_long", F.col("t").rlike("[A-Za-z0-9+/_-]{20}"))
    found = with_spans(text, "t", {"assign": (ASSIGN, F.col("_named")), "access": (ACCESS, F.contains("t", F.lit("AKIA"))), "hex": (HEX, F.col("_long")), "token": (TOKEN, F.col("_long"))})
    found = found.select("doc_id", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], f"^{_KEY}(.*)$", 1)) >= 6).alias("assign"), "access", "hex", "token")
    base = F.concat("assign", "access", "hex")
    found = found.select("doc_id", "assign", "access", "hex", F.when(F.size("token") > 0, F.filter("token", lambda x: ~overlaps(x, base))).otherwise(no_spans()).alias("token"))
    found = keep(found.select("doc_id", "assign", "access", "hex", F.when(F.size("token") > 0, battery(F.col("token"))).alias("token")), "secrets")
    limits = thresholds(found.select(F.explode("token").alias("c")).select("c.band", "c.enc", "c.step", "c.h"), ordinary_steps(docs.sparkSession))
    limit = lambda x: F.coalesce(*(F.when((x["band"] == b) & (x["enc"] == e), F.lit(step)) for (b, e), step in limits.items()), F.lit(-1))
    chosen = F.transform(F.filter(F.coalesce("token", F.array().cast(found.schema["token"].dataType)), lambda x: x["step"] <= limit(x)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m")))
    return found.select("doc_id", "assign", "access", "hex", chosen.alias("random"))


KINDS = ("assign", "access", "hex", "random")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents: counts and digest of the base spans, and all spans, one row a row."""
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(KINDS[:3], False), 256).alias("base_sha256"), listed(KINDS, False).alias("spans"))
