"""PII by candidate gradient boosting.

Base patterns give the sure spans. High-recall generators propose further, overlapping spans: numbers in
groups, obfuscated addresses, account numbers, and within those what has the format of a phone, SSN or card
number or a country's account length, whatever stands beside it. Boosted trees over format and context features score each
proposal, calibrated thresholds accept it, and of accepted proposals that overlap the
best stays. The trees are trained here, on made-up labelled sentences of a fixed number, with features
from the same SQL that the corpus gets, and run as SQL. Thresholds are calibrated on sentences of another
making: other words, other leads, other formats, other shares. SQL functions only on the main path.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .spans import SPANS, listed, no_spans, overlaps, plain_text, with_spans

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Generators of proposals: anything like a number in groups, an address in words, an account.
#: Quantifiers are possessive, so that matching is linear and needs no stack, whatever the length.
NUMBER = r"(?<![A-Za-z0-9.+])(?=\(?(?:[0-9][\x20().-]{0,2}){7})\(?[0-9]++(?![A-Za-z])(?:[\x20().-]{1,2}[0-9]++(?![A-Za-z]))*+"
WORDED = r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._%+-]*+\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]++(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[a-z0-9-]++)++"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
#: Formats that stand beside other groups: they start and end at group boundaries, whatever is before and after.
GROUPED_PHONE = r"(?<![A-Za-z0-9])(?:\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{3}[\x20.-][0-9]{7}|0[0-9]{2}[\x20.-][0-9]{4}[\x20.-][0-9]{4})(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![A-Za-z0-9])"
GROUPED_CARD = r"(?<![A-Za-z0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![A-Za-z0-9])"
#: Characters of an account number by country.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|NL", 19: "SI", 20: "AT|EE|LT|LU", 21: "CH|HR|LI|LV", 22: "BG|DE|GB|IE", 24: "AD|CZ|ES|RO|SE|SK", 25: "PT", 27: "FR|GR|IT|MC", 28: "CY|HU|PL", 31: "MT"}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("worded", "account", "number")
#: The generators of each added kind; what they propose may overlap.
GENERATORS = {"worded": (WORDED,), "account": (ACCOUNT, IBAN), "number": (NUMBER, GROUPED_PHONE, SSN, GROUPED_CARD)}
#: Code points of context before a proposal.
CONTEXT = 32
FEATURES = ("kind", "digits", "length", "groups", "first", "last", "luhn", "ssn", "date", "dots", "parens", "country", "letters", "said_phone", "said_card", "said_id", "said_account", "said_mail", "said_other", "money")
SAMPLES, TREES, RATE = 1200, 12, 0.5


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of a short string pass the Luhn check."""
    figures = F.reverse(digits(x))

    def add(total: Column, i: Column) -> Column:
        v = F.substring(figures, i, F.lit(1)).cast("int") * (F.pmod(i + 1, F.lit(2)) + 1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(figures), F.lit(1))), F.lit(0), add), F.lit(10)) == 0


def replaced(text: Column, spans: Column, mark, same_length: bool = False) -> Column:
    """Pieces of the text up to the end of its spans (s, e by start), each span replaced by mark(length).

    A struct: p, where the text goes on, and out, the pieces. Of overlapping spans the first has the mark,
    what others add to it is left out with no mark of its own, but keeps its length if marks do (same_length).
    """

    def step(a: Column, x: Column) -> Column:
        start = F.greatest(a["p"], x["s"])
        piece = F.concat(F.substring(text, a["p"] + 1, start - a["p"]), mark(F.greatest(x["e"] - start, F.lit(0))))
        within = x["s"] < a["p"]
        longer = F.concat(a["out"], F.array(F.when(within & F.lit(not same_length), F.lit("")).otherwise(piece)))
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), longer.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("out")), step)


def joined(text: Column, cut: Column) -> Column:
    return F.concat(F.array_join(cut["out"], ""), F.substring(text, cut["p"] + 1, F.length(text)))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with a column of spans for each of BASE; text is a plain_text column."""
    has = lambda c: F.contains(text, F.lit(c))
    digit = F.col("_digit")  # most texts hold none: one look spares the patterns that need some
    found = with_spans(docs.withColumn("_digit", F.col(text).rlike("[0-9]")), text, {"email": (EMAIL, has("@")), "ip": (IP, digit), "card": (CARD, digit), "phone": (PHONE, has("+"))}).drop("_digit")
    n = lambda x: F.length(digits(x["m"]))
    return found.withColumns({
        "ip": F.filter("ip", lambda x: x["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter("card", lambda x: F.when(n(x).between(13, 19), luhn(x["m"])).otherwise(F.lit(False))),
        "phone": F.filter("phone", lambda x: n(x).between(9, 15)),
    })


def features(x: Column) -> Column:
    """The features of a proposal (kind, m, figures, before): its format, and the words before it."""
    m, figures, before = x["m"], x["figures"], x["before"]
    said = lambda words: before.rlike(words)
    group = F.split(F.regexp_replace(m, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), "[^0-9A-Za-z]+")
    values = {
        "kind": x["kind"], "digits": F.length(figures), "length": F.length(m), "groups": F.size(group), "first": F.length(group[0]), "last": F.length(F.element_at(group, -1)),
        "luhn": F.when(F.length(figures).between(13, 19), luhn(figures)).otherwise(F.lit(False)),
        "ssn": m.rlike(r"^[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}$"),
        "date": m.rlike(r"^(?:(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2})$"),
        "dots": F.regexp_count(m, F.lit(r"\.")), "parens": F.contains(m, F.lit("(")),
        "country": m.rlike("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]{2}"),
        "letters": F.regexp_count(m, F.lit("[A-Za-z]")),
        "said_phone": said(r"phone|\btel|call|mobile|\bfax|cell|whatsapp"), "said_card": said(r"card|visa|master|credit|amex"), "said_id": said(r"ssn|social|passport|tax id|national|licen"),
        "said_account": said(r"iban|account|bank|acct"), "said_mail": said(r"mail|contact|write|reach|address"), "said_other": said(r"isbn|order|invoice|version|part|serial|item|ref|page|total|score|\bid\b|#"), "money": said(r"(?:\$|€|£|usd|eur)\s*$"),
    }
    return F.array(*(values[f].cast("double") for f in FEATURES))


def proposals(docs: DataFrame, text: str) -> DataFrame:
    """docs with `proposed`: array of s, e, kind, f (features), proposals that no base span overlaps."""
    spans = F.array_sort(F.transform(F.concat(*BASE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    hidden = docs.withColumn("_sure", spans)
    hidden = hidden.withColumn("_cut", F.when(F.size("_sure") > 0, replaced(F.col(text), F.col("_sure"), lambda n: F.repeat(F.lit("\x03"), n), same_length=True)))
    hidden = hidden.withColumn("_rest", F.coalesce(joined(F.col(text), F.col("_cut")), F.col(text)))
    generators = {f"_{k}{j}": (k, p) for k in ADDED for j, p in enumerate(GENERATORS[k])}
    hidden = hidden.withColumn("_digit", F.col("_rest").rlike("[0-9]"))
    found = with_spans(hidden, "_rest", {n: (p, F.col("_rest").rlike(r"(?i)[\[({]\x20?at") if k == "worded" else F.col("_digit")) for n, (k, p) in generators.items()})

    def proposed(i: int):  # a lambda with a second parameter would get the element's index in it
        begin = lambda x: F.greatest(x["s"] - CONTEXT, F.lit(0))
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("kind"), x["m"].alias("m"), digits(x["m"]).alias("figures"), F.lower(F.substring(F.col(text), begin(x) + 1, x["s"] - begin(x))).alias("before"))

    parts = [F.transform(F.array_distinct(F.concat(*(F.col(n) for n, (of, _) in generators.items() if of == k))), proposed(i)) for i, k in enumerate(ADDED)]
    scored = F.transform(F.concat(*parts), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), features(x).alias("f")))
    return found.withColumn("proposed", scored).drop(*generators, "_sure", "_cut", "_rest", "_digit")


def account_number(rng: random.Random, country: str, grouped: bool) -> str:
    """A made-up account of the country's length, in groups of four or in one."""
    length = next(n for n, countries in IBAN_LENGTHS.items() if country in countries.split("|"))
    plain = country + "".join(rng.choice("0123456789") for _ in range(length - 2))
    return " ".join(plain[i : i + 4] for i in range(0, length, 4)) if grouped else plain


def samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[int, str, int, int]]:
    """Made-up sentences with one number, address or account each, to train on: (id, sentence, kind, label)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 8)))
    sep = lambda: rng.choice("- .")

    def phone() -> str:
        s = sep()
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(7)}", f"0{d(2)} {d(4)} {d(4)}"])

    def card() -> str:
        s = rng.choice(["", " ", "-"])
        return s.join(d(4) for _ in range(4))

    def account() -> str:
        return account_number(rng, rng.choice(["DE", "FR", "GB", "ES", "NL", "NO", "CH"]), rng.random() < 0.5)

    def worded() -> str:
        a, b = rng.choice(["[at]", "(at)", " [at] ", " (at) "]), rng.choice([".", " [dot] ", "(dot)", " (dot) "])
        return f"{word()}{rng.choice(['.', '_', ''])}{word()}{a}{word()}{b}{rng.choice(['com', 'org', 'net', 'de'])}"

    yes = [
        (2, phone, ("call me on", "phone:", "tel.", "mobile", "fax", "my cell is", "whatsapp")), (2, phone, ("", "and", "with", "number")),
        (2, card, ("credit card", "visa", "card no.", "mastercard", "pay by card")), (2, lambda: f"{d(3)}-{d(2)}-{d(4)}", ("ssn", "social security", "", "my number is", "national id")),
        (1, account, ("iban", "account", "bank account", "", "send it to")), (0, worded, ("mail", "contact", "write to", "", "reach me at")),
    ]
    no = [
        (2, lambda: d(rng.randint(7, 14)), ("order", "invoice", "serial", "ref", "item #", "", "and", "total", "score", "part")), (2, lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", ("on", "since", "", "call by", "date")),
        (2, lambda: f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", ("isbn", "isbn-13", "", "book")), (2, lambda: f"{rng.randint(1, 9)}{d(2)}.{d(3)}.{d(3)}", ("$", "€", "total", "usd", "population", "")),
        (2, lambda: ".".join(d(rng.randint(1, 2)) for _ in range(rng.randint(4, 6))), ("version", "section", "", "part")), (2, lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 8))), ("score", "rows", "", "numbers", "and")),
        (2, card, ("order", "invoice", "serial", "item", "ref", "", "and", "with")), (2, lambda: d(rng.randint(13, 19)), ("", "and", "with", "order", "number")), (2, lambda: ".".join(d(rng.randint(1, 3)) for _ in range(4)), ("", "and", "at", "from")), (1, lambda: "".join(rng.choice("AB") for _ in range(2)) + d(2) + "".join(rng.choice("ABCDEFG12") for _ in range(14)), ("part", "serial", "item", "order", "version")),
        (0, lambda: f"{word()} (at) {rng.randint(1, 12)}.{rng.randint(10, 59)}", ("meet", "lunch", "", "dinner")),
    ]
    out = []
    for i in range(n):
        label = i % 2
        kind, make, heads = rng.choice(yes if label else no)
        out.append((i, f"{word()} {word()} {rng.choice(heads)} {make()} {word()} {word()}", kind, label))
    return out


def other_samples(n: int = SAMPLES, seed: int = 23) -> list[tuple[int, str, int, int]]:
    """Sentences to calibrate on, made apart from samples(): prose words around, leads and formats that those lack."""
    rng = random.Random(seed)
    pick = rng.choice
    figures = lambda k: f"{rng.randrange(10 ** (k - 1), 10**k)}"
    prose = "the report was sent before noon and nobody at our office had seen it yet so please look again when you can thanks we will meet on monday near station".split()
    some = lambda: " ".join(pick(prose) for _ in range(rng.randint(2, 7)))
    names, hosts = ("anna", "m.ortiz", "lee_k", "j-weber", "support", "sales.eu", "tom77"), ("posteo", "mail-box", "acme", "uni-ulm", "shop")

    def spaced(*sizes: int, by: str) -> str:
        return by.join(figures(k) for k in sizes)

    people = (
        (2, lambda: pick((f"({figures(3)}){figures(3)}-{figures(4)}", spaced(3, 3, 4, by=pick(" .-")), f"0{figures(3)}-{figures(7)}", f"0{figures(2)}-{figures(4)}-{figures(4)}")), ("ring me:", "telephone", "my mobile no is", "cell", "you can call", "Fax", "")),
        (2, lambda: spaced(4, 4, 4, 4, by=pick((" ", "-"))), ("debit card", "Mastercard ending", "charge my visa", "the credit card I used is")),
        (2, lambda: spaced(3, 2, 4, by=pick("- ")), ("SSN:", "my social security no", "passport or ssn", "")),
        (1, lambda: account_number(rng, pick(("AT", "BE", "IT", "PL", "SE", "FI", "PT")), rng.random() < 0.5), ("IBAN:", "wire it to my bank account", "acct", "")),
        (0, lambda: f"{pick(names)}{pick((' (at) ', '[at]', ' [at] ', '{at}'))}{pick(hosts)}{pick(('.', '[dot]', ' (dot) '))}{pick(('eu', 'info', 'co', 'ch'))}", ("e-mail", "write me:", "contact", "you reach us under", "")),
    )
    things = (
        (2, lambda: figures(rng.randint(7, 16)), ("order no", "tracking", "ticket", "SKU", "serial", "case", "invoice", "")), (2, lambda: f"{rng.randint(10, 31)}.{rng.randint(10, 12)}.{rng.randint(1950, 2029)}", ("born", "due", "since", "")),
        (2, lambda: f"{rng.randint(1950, 2029)}.{rng.randint(10, 12)}.{rng.randint(10, 31)}", ("on", "dated", "")), (2, lambda: spaced(3, 10, by="-"), ("isbn", "the book", "")), (2, lambda: spaced(*(2,) * rng.randint(4, 6), by=" "), ("lottery", "rows", "total", "numbers")),
        (2, lambda: spaced(1, 3, 3, 3, by="."), ("€", "population", "a total of", "")), (2, lambda: spaced(4, 4, 4, 4, by=pick(" -")), ("order", "serial", "part", "item ref")), (2, lambda: ".".join(str(rng.randint(1, 40)) for _ in range(rng.randint(4, 6))), ("version", "build", "section")),
        (1, lambda: pick(("AX", "QR", "ZT", "KB")) + figures(2) + "".join(pick("ABCDEF0123456789") for _ in range(14)), ("part", "serial", "model", "item")), (0, lambda: f"{pick(prose)} (at) {rng.randint(1, 12)}.{rng.randint(10, 59)}", ("see you", "doors open", "")),
    )
    out = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        kind, make, leads = pick(people if label else things)
        out.append((i, f"{some()} {pick(leads)} {make()} {some()}", kind, label))
    return out


class Boosted:
    """Gradient boosting of trees of depth two for logistic loss, on a few thousand rows in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> None:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees, f = [], np.full(len(y), self.start)
        cuts = [np.unique((v[1:] + v[:-1]) / 2) for v in (np.unique(c) for c in x.T)]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree = self.grow(x, g, h, np.arange(len(y)), cuts, 2, rate)
            f = f + self.apply(tree, x)
            self.trees.append(tree)

    def grow(self, x, g, h, at, cuts, depth, rate):
        value = rate * g[at].sum() / (h[at].sum() + 1.0)
        best = (1e-9, None, None)
        whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for j, options in enumerate(cuts) if depth else ():
            for c in options:
                left = x[at, j] < c
                if not 5 <= left.sum() <= len(at) - 5:
                    continue
                a, b = at[left], at[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, j, float(c))
        if best[1] is None:
            return float(value)
        left = x[at, best[1]] < best[2]
        return best[1], best[2], *(self.grow(x, g, h, part, cuts, depth - 1, rate) for part in (at[left], at[~left]))

    def apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] < c, self.apply(low, x), self.apply(high, x))

    def score(self, x):
        return self.start + sum(self.apply(t, x) for t in self.trees)

    def sql(self, x: Column) -> Column:
        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            j, c, low, high = tree
            return F.when(x[j] < c, of(low)).otherwise(of(high))

        total = F.lit(self.start)
        for t in self.trees:
            total = total + of(t)
        return total


def _proposed(spark: SparkSession, *made: list[tuple[int, str, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set of made-up sentences the features and labels of what is proposed in them; a proposal counts if it is
    of its sentence's kind."""
    every = [(part, i, t, k, y) for part, rows in enumerate(made) for i, t, k, y in rows]
    rows = spark.createDataFrame([(part, i, t, k) for part, i, t, k, _ in every], "part int, id int, t string, k int")
    rows = proposals(rows.withColumns({k: no_spans() for k in BASE}), "t").select("part", "id", "k", F.explode("proposed").alias("c")).where("c.kind = k")
    label = {(part, i): y for part, i, _, _, y in every}
    found = sorted((r.part, r.id, list(r.f)) for r in rows.select("part", "id", "c.f").collect())  # about SAMPLES rows a set
    return [(np.array([f for p, _, f in found if p == part]), np.array([label[part, i] for p, i, _ in found if p == part], float)) for part in range(len(made))]


_TRAINED: dict[float, tuple[Boosted, list[float]]] = {}


def train(spark: SparkSession, precision: float = 0.95) -> tuple[Boosted, list[float]]:
    """The trees, and for each added kind the least score at which the precision on other_samples() is as asked for. The
    sentences are always the same, so a driver trains once."""
    if precision not in _TRAINED:
        _TRAINED[precision] = _trained(spark, precision)
    return _TRAINED[precision]


def _trained(spark: SparkSession, precision: float) -> tuple[Boosted, list[float]]:
    trained, (x, y) = _proposed(spark, samples(), other_samples())
    model = Boosted(*trained)
    score, limits = model.score(x), []
    for kind in range(len(ADDED)):
        mine = x[:, 0] == kind
        order = np.argsort(-score[mine], kind="stable")
        ranked, right = score[mine][order], np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        ends = np.flatnonzero(np.r_[ranked[1:] != ranked[:-1], True])  # proposals of one score are taken together
        good = ends[right[ends] >= precision]
        limits.append(max(0.0, float(ranked[good[-1]])) if len(good) else math.inf)
    return model, limits


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and the spans: email, ip, card, phone (base) and added; with
    keep_text all columns of docs, prefixed by nothing, and `_t`, the text scanned.

    Null texts count as empty and have no spans; repeated rows repeat; an empty table stays empty. Rows
    are judged one by one, so no other column or row matters.
    """
    model, limits = train(docs.sparkSession)
    docs = docs.select("*" if keep_text else "doc_id", plain_text(F.col("text")).alias("_t"))
    found = proposals(base_spans(docs, "_t"), "_t")
    scored = F.transform("proposed", lambda x: F.struct((-model.sql(x["f"])).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    limit = lambda x: F.coalesce(*(F.when(x["kind"] == i, F.lit(v)) for i, v in enumerate(limits)))
    good = F.array_sort(F.filter(scored, lambda x: -x["o"] >= limit(x)))
    # of accepted proposals that overlap, the one with the best score, then the first, stays
    span = lambda x: F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m")))
    added = F.aggregate(good, no_spans(), lambda a, x: F.when(overlaps(x, a), a).otherwise(F.concat(a, span(x).cast(SPANS))))
    return found.withColumn("added", F.when(F.size("proposed") > 0, added).otherwise(no_spans())).drop("proposed")


KINDS = (*BASE, "added")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents: counts and digest of the base spans, and all spans, one row a row."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE), F.sha2(listed(BASE, True), 256).alias("base_sha256"), listed(KINDS, True).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with all spans redacted; n_chars, where there is one, follows the text. Other texts stay as they are."""
    names = docs.columns
    renamed = docs.select(*(F.col(c).alias(f"_c_{c}") if c != "text" else F.col(c) for c in names))
    found = scan(renamed, keep_text=True)
    spans = F.array_sort(F.transform(F.concat(*KINDS), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    found = found.withColumn("_all", spans)
    found = found.withColumn("_cut", F.when(F.size("_all") > 0, replaced(F.col("_t"), F.col("_all"), lambda n: F.lit("[redacted]"))))
    found = found.withColumn("_new", joined(F.col("_t"), F.col("_cut")))
    changed = {"text": F.coalesce("_new", "text"), "n_chars": F.coalesce(F.length("_new").cast("bigint"), F.col("_c_n_chars")) if "n_chars" in names else None}
    return found.select(*((changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"_c_{c}")).alias(c) for c in names))
