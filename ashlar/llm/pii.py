"""Personal data: candidate spans, boosted trees, calibrated thresholds - Spark functions only.

Exact rules give the base spans.  Generators of high recall propose further, overlapping
candidates (numbers with looser separators, addresses with written-out signs, national phone
numbers), which the base rules miss.  Every candidate has format and context features.  The
labels do not repeat the base rules: in learning, every base span is disguised where it
stands, in one of several ways, so that no base rule finds it, and keeps its label; what else
the generators propose is not personal data.  Boosted trees learn from all candidates so
made, counted by feature vector; the vectors are bounded by the features' grid, whatever the
corpus.  A threshold for each kind is calibrated on documents by trees of others, and
candidates above it that touch no base span are selected.  Text work is split, extraction and array functions in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

KINDS = ("email", "ip", "card", "phone")
_local, _host = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base rules.  Possessive, and started only where a run starts or the last match
#: ended, so that no text makes them go back over itself; they match the same strings.
BASE = {
    "email": rf"(?:\G|(?<!{_local})){_local}++@{_host}++(?:\.{_host}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_at = r"(?: ?@ ?| ?[\[({<] ?(?:at|AT) ?[\])}>] ?| at | AT )"
_dot = r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT )"
#: Generators: kind and pattern.
LOOSE = {
    "email": rf"(?<!{_local}){_local}{{1,64}}+{_at}{_host}{{1,63}}+(?:{_dot}{_host}{{1,63}}+){{1,8}}+",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:(?: ?[.,] ?|{_dot})[0-9]{{1,3}}+){{3}}",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00 ?)?[(]?[0-9](?:[ ()./-]{0,3}[0-9]){8,14}(?![0-9])",
}
#: Whether a text can hold a match at all; cheap tests before the patterns.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
LOOSE_HINT = {
    "email": lambda t: t.contains("@") | t.rlike(r"(?:dot|DOT)[ \])}>]"),
    "ip": lambda t: t.rlike(rf"[0-9](?: ?[.,] ?|{_dot})[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ ./_-]{0,3}[0-9]){11}"),
    "phone": lambda t: t.rlike(r"[0-9](?:[ ()./-]{0,3}[0-9]){8}"),
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|addr)",
    "card": r"(?i)(?:card|visa|credit|pay|account)",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|dial)",
}
SPAN = "array<struct<kind:int,s:int,e:int,m:string,left:string,right:string>>"
#: Beside more digits: the base rules may have dropped the span only because they take both together.
MERGED = (r"[0-9][ -]?$", r"^[ -]?[0-9]")
FEATURES = ("kind", "digits", "luhn", "signs", "left", "right", "cue", "fits", "lead")


#: Parts of the documents, by a hash of the id, that trees of the others calibrate.
FOLDS = 5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(d)
    parts = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The base rule's further condition on a match."""
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def located(text: Column, kind: int, pattern: str, hint: Column, fits: Callable[[Column], Column] = lambda m: F.lit(True)) -> Column:
    """Matches that fit, leftmost and not overlapping, with code point positions (end
    exclusive) and up to 24 characters before and two after.  The pieces between matches give the
    positions, in one pass over the matches."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    z = F.arrays_zip(between, found, F.slice(between, F.lit(2), F.size(between)))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["0"])
        e = s + F.coalesce(F.length(x["1"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["1"].alias("m"), F.right(x["0"], F.lit(24)).alias("left"), F.left(x["2"], F.lit(2)).alias("right"))
        return F.struct(e.alias("at"), F.when(x["1"].isNotNull() & fits(x["1"]), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(hint, F.aggregate(z, start, step)["out"]).otherwise(F.array().cast(SPAN))


def base(text: Column) -> Column:
    """The base spans, by start and kind."""
    def of(i: int, k: str) -> Column:
        return located(text, i, BASE[k], HINT[k](text), lambda m: valid(k, m))

    all_ = [of(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*all_), lambda a, b: F.when((a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["kind"] < b["kind"])), -1).otherwise(F.when((a["s"] == b["s"]) & (a["kind"] == b["kind"]), 0).otherwise(1)))


def candidates(text: Column) -> Column:
    return F.concat(*(located(text, i, LOOSE[k], LOOSE_HINT[k](text)) for i, k in enumerate(KINDS)))


def touches(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def disguise(x: Column) -> Column:
    """A base span's string written so that no base rule finds it, in a way that its hash chooses."""
    m, d = x["m"], digits(x["m"])
    way = F.pmod(F.xxhash64(m, x["s"]), F.lit(4))

    def one(*forms: Column) -> Column:
        return F.coalesce(*(F.when(way == i, f) for i, f in enumerate(forms)))

    signs = lambda at, dot: F.replace(F.replace(m, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
    fours = lambda sign: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sign}")
    national = F.regexp_replace(m, r"^\+[0-9]{1,2}[ .-]?", "")
    of = {
        "email": one(signs(" at ", " dot "), signs(" [at] ", " [dot] "), signs("(at)", "(dot)"), signs(" @ ", ".")),
        "ip": one(signs("@", "[.]"), signs("@", " . "), signs("@", ","), signs("@", " dot ")),
        "card": one(fours("."), fours(" - "), fours("/"), fours("_")),
        "phone": one(F.concat(F.lit("00"), F.substring(m, 2, 64)), national, F.substring(m, 2, 64), F.regexp_replace(national, "[^0-9]+", ".")),
    }
    return F.coalesce(*(F.when(x["kind"] == i, of[k]) for i, k in enumerate(KINDS)))


def disguised(text: Column, b: Column) -> Column:
    """The text with its base spans disguised (one that overlaps the one before it is left), and where those are then."""

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["s"] - a["at"])
        new = disguise(x)
        s = F.length(a["text"]) + F.length(gap)
        span = F.struct(x["kind"].alias("kind"), s.alias("s"), (s + F.length(new)).alias("e"))
        free = x["s"] >= a["at"]
        return F.struct(F.when(free, x["e"]).otherwise(a["at"]).alias("at"), F.when(free, F.concat(a["text"], gap, new)).otherwise(a["text"]).alias("text"), F.when(free, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    done = F.aggregate(b, F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), none.alias("spans")), step)
    done = F.struct(F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text))).alias("text"), done["spans"].alias("spans"))
    return F.when(F.size(b) > 0, done).otherwise(F.struct(text.alias("text"), none.alias("spans")))


def _sort(c: Column) -> Column:
    """Class of a neighbouring character: none or blank, letter, digit, other."""
    return F.when(F.coalesce(c, F.lit("")).isin("", " ", "\n", "\t"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def features(x: Column) -> list[Column]:
    """Small whole numbers, in the order of FEATURES."""
    d = digits(x["m"])
    n = F.length(d)
    by_kind = lambda of: F.coalesce(*(F.when(x["kind"] == i, of(k)) for i, k in enumerate(KINDS)))
    signs = F.size(F.array_distinct(F.split(F.regexp_replace(x["m"], "[A-Za-z0-9]", ""), "")))
    fits = {"email": x["m"].rlike(r"(?i)(?:\.|dot ?[\])}>]? ?)[a-z]{2,}$"), "ip": F.forall(F.split(x["m"], "[^0-9]+"), lambda p: p.rlike("^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")), "card": d.rlike("^[2-6]"), "phone": x["m"].rlike(r"^[+(]|^00")}
    return [
        x["kind"],
        F.least(n, F.lit(20)),
        F.when((x["kind"] == 2) & n.between(12, 19), luhn(d).cast("int")).otherwise(0),
        F.least(signs, F.lit(5)),
        _sort(F.right(x["left"], F.lit(1))),
        _sort(F.left(x["right"], F.lit(1))),
        by_kind(lambda k: x["left"].rlike(CUES[k])).cast("int"),
        by_kind(lambda k: fits[k]).cast("int"),
        F.when(x["m"].startswith("+"), 1).when(x["m"].startswith("("), 2).otherwise(0),
    ]


@dataclass
class Model:
    """Trees of a test and a further one on either side: (feature, at most, (feature, at most)
    of each side, four leaves); a threshold a kind; and of the kinds' held-out candidates how
    many it selects, how many of those are disguised spans, and how many there are of them."""

    trees: list[tuple] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [float("inf")] * len(KINDS))
    held_out: dict[str, tuple[int, int, int]] = field(default_factory=dict)

    def score(self, f: list[Column]) -> Column:
        total = F.lit(0.0)
        for a, x, sides, leaves in self.trees:
            low, high = (F.when(f[b] <= y, leaves[2 * i]).otherwise(leaves[2 * i + 1]) for i, (b, y) in enumerate(sides))
            total = total + F.when(f[a] <= x, low).otherwise(high)
        return total

    def values(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        for a, x, sides, leaves in self.trees:
            side = (v[:, a] > x).astype(int)
            further = np.where(side, v[:, sides[1][0]] > sides[1][1], v[:, sides[0][0]] > sides[0][1])
            out += np.asarray(leaves)[2 * side + further]
        return out


def boost(v: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 40, rate: float = 0.5, ridge: float = 1.0) -> Model:
    """Logistic boosting over distinct feature vectors with their counts."""
    m = Model()
    f = np.zeros(len(v))
    tests = [(i, x) for i in range(v.shape[1]) for x in np.unique(v[:, i])[:-1]]
    n = good + bad
    for _ in range(rounds if tests else 0):
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        g, h = good - n * p, n * p * (1 - p)

        def best(among: np.ndarray) -> tuple[int, int]:
            def gain(t: tuple) -> float:
                on = v[:, t[0]] > t[1]
                return sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (among & on, among & ~on))

            i, x = max(tests, key=gain)
            return int(i), int(x)

        a, x = best(np.ones(len(v), bool))
        right = v[:, a] > x
        sides = best(~right), best(right)
        cells = [half & (low == (v[:, b] <= y)) for half, (b, y) in zip((~right, right), sides) for low in (True, False)]
        m.trees.append((a, x, sides, tuple(float(rate * g[s].sum() / (h[s].sum() + ridge)) for s in cells)))
        f = m.values(v)
    return m


def counted(docs: DataFrame) -> DataFrame:
    """Candidates of all docs (doc_id, text), their base spans disguised, by feature vector and
    ``held``, the fold that holds the document out: n, and how many touch a disguised span of
    their kind.  Of cards beside more digits, whose label no rule tells, only those count; what
    touches a span of another kind does not count (one of both will stay)."""
    t = F.col("text")
    d = docs.select("doc_id", F.coalesce(t, F.lit("")).alias("text")).select("doc_id", "text", base(t).alias("base"))
    d = d.select("doc_id", disguised(t, F.col("base")).alias("d")).select("doc_id", F.col("d.spans").alias("spans"), candidates(F.col("d.text")).alias("c"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    good = lambda c: F.exists("spans", lambda b: (b["kind"] == c["kind"]) & touches(b, c))
    next_to = lambda c: F.exists("c", lambda o: (o["kind"] == c["kind"]) & ((o["s"] - c["e"]).between(0, 1) | (c["s"] - o["e"]).between(0, 1)))
    other = lambda c: F.exists("spans", lambda b: touches(b, c))
    told = lambda c: good(c) | ~other(c) & ((c["kind"] != KINDS.index("card")) | ~(c["left"].rlike(MERGED[0]) | c["right"].rlike(MERGED[1]) | next_to(c)))
    x = d.select(fold.alias("held"), F.explode(F.transform(F.filter("c", told), lambda c: F.struct(*(y.alias(n) for n, y in zip(FEATURES, features(c))), good(c).alias("good")))).alias("x"))
    return x.groupBy("held", *(F.col(f"x.{n}").alias(n) for n in FEATURES)).agg(F.count("*").alias("n"), F.sum(F.col("x.good").cast("int")).alias("good"))


def train(rows: list, precision: float = 0.95, least: int = 5) -> Model:
    """Trees from all counts, thresholds from the scores that each fold's counts get from trees
    of the other folds.  A kind whose candidates never reach the precision selects none."""
    if not rows:
        return Model()
    v = np.array([[r[n] or 0 for n in FEATURES] for r in rows])
    n, good, held = (np.array([r[c] for r in rows]) for c in ("n", "good", "held"))
    if len(np.unique(held)) < 2:
        return Model()
    bad = (n - good).astype(float)
    m = boost(v, good.astype(float), bad)
    score = np.zeros(len(v))
    for fold in np.unique(held):
        score[held == fold] = boost(v[held != fold], good[held != fold].astype(float), bad[held != fold]).values(v[held == fold])
    for k in range(len(KINDS)):
        mine = v[:, 0] == k
        order = np.argsort(-score[mine], kind="stable")
        s, a, b = score[mine][order], np.cumsum(good[mine][order]), np.cumsum(n[mine][order])
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        ok = last & (a >= precision * b) & (b >= least)
        all_ = int(good[mine].sum())
        m.held_out[KINDS[k]] = (0, 0, all_)
        if ok.any():
            at = np.flatnonzero(ok)[-1]
            m.thresholds[k] = float(s[at]) - 1e-9
            m.held_out[KINDS[k]] = (int(b[at]), int(a[at]), all_)
    return m


def fit(docs: DataFrame) -> Model:
    """Learn from all of docs (doc_id, text); the driver gets counts by feature vector, bounded by
    their grid.  Null texts are empty; documents with a null id are of the first fold; repeated rows
    count each; without base spans or candidates the model adds nothing."""
    return train(counted(docs).collect())


def both(text: Column, model: Model) -> tuple[Column, Column]:
    """(base spans, all spans) of a text, each by start and kind."""
    b = base(text)
    on = [t for t in model.thresholds if t != float("inf")]
    if not on:
        return b, b
    limit = lambda c: F.coalesce(*(F.when(c["kind"] == i, F.lit(t)) for i, t in enumerate(model.thresholds)))
    return b, F.transform(candidates(text), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), c["left"].alias("left"), c["right"].alias("right"), model.score(features(c)).alias("score"), limit(c).alias("limit")))


def find(docs: DataFrame, model: Model, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs' columns with ``base`` and ``spans``, in place of columns of those names: arrays of
    (kind, s, e) by start and kind, code points, end exclusive; kind by its place in KINDS.

    Null texts are empty; rows map one to one, repeated ones too.  Of selected candidates that
    overlap, the longest stays (it may hold a shorter number of another kind), of equally long
    the likeliest, then the earliest."""
    t_, b_, more = (fresh([*docs.columns, base, spans], c) for c in ("_text", "_base", "_more"))
    b, c = both(F.col(t_), model)
    d = docs.withColumn(t_, F.coalesce(F.col(text), F.lit(""))).withColumn(b_, b)
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    d = d.withColumn(b_, F.transform(b_, slim))
    if c is b:
        return d.withColumns({base: F.col(b_), spans: F.col(b_)}).drop(t_, b_)
    d = d.withColumn(more, F.filter(F.filter(c, lambda x: x["score"] >= x["limit"]), lambda x: ~F.exists(b_, lambda y: touches(x, y))))
    size = lambda x: x["e"] - x["s"]
    first = lambda o, x: F.struct(size(o), o["score"], -o["s"], -o["kind"]) > F.struct(size(x), x["score"], -x["s"], -x["kind"])
    better = lambda o, x: touches(o, x) & first(o, x)
    d = d.withColumn(more, F.filter(more, lambda x: ~F.exists(more, lambda o: better(o, x))))
    every = F.array_sort(F.concat(b_, F.transform(more, slim)), lambda a, b: F.when((a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["kind"] < b["kind"])), -1).otherwise(1))
    return d.withColumns({base: F.col(b_), spans: every}).drop(t_, b_, more)


def listed(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps a span already replaced goes with it."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], more).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans_, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans_) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
