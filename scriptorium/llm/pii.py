"""Personal data by weak supervision.

Fixed patterns give the base spans.  Wider patterns give more candidates.  Labelers of three kinds (regex, gazetteer,
context) vote on every candidate, base ones included; expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability for each kind of data; the posteriors then train a naive Bayes span classifier on
features of the span and its surroundings, and the candidates it accepts join the base spans.  DataFrame functions only:
what reaches the driver are counts by vote pattern and sums by feature, whose number is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written

#: Kinds in order, and their patterns.  Possessive repeats match what greedy ones would, without deep
#: recursion; the look-behinds skip starts inside a run, where a match would have begun at the run's start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates: addresses spelt out, numbers without a country code, credentials.
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}",
    "phone": r"(?<![A-Za-z0-9+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z_]{2,32}+[ ]?[=:][ ]?\"?[A-Za-z0-9/+_-]{12,}+|(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])",
}
KINDS = ["email", "ip", "card", "phone", "secret"]
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers.
DOMAINS = r"(?i)(?:\.|dot[ )\]]{1,2})(?:com|org|net|edu|gov|info|de|fr|es|uk|eu)$"
CREDENTIAL_WORDS = r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api_?key|access_?key|auth)\"? ?[=:]|^AKIA"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
LOCAL_ADDRESSES = r"^(?:0|10|127|192\.168|255)\."
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|correo|courriel)\W{0,3}\w{0,8}\W{0,3}$",
    "ip": r"(?i)(?:ip|host|server|addr(?:ess)?|from)\W{0,3}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)\W{0,3}\w{0,8}\W{0,3}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|cell)\w{0,6}\W{0,3}$",
    "secret": r"(?i)(?:key|login|credential|user)\w{0,4}\W{0,3}$",
}
AROUND = 24
SPANS = "array<struct<start:int,end:int,kind:int,body:string,left:string,right:string>>"
#: Matches that one short array collects.
BLOCK = 256
LABELERS = ["pattern", "check", "gazetteer", "cue", "edges", "shape"]
ROUNDS = 25


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    d = _digits(body)
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.when(i % 2 == 1, _at(d, i)).otherwise((_at(d, i) * 2) % 10 + F.floor(_at(d, i) / 5).cast("int"))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def _at(d: Column, i: Column) -> Column:
    """The i-th digit from the right."""
    return F.coalesce(F.call_function("substring", d, -i, F.lit(1)).try_cast("int"), F.lit(0))


def _valid(kind: str, body: Column) -> Column:
    n = F.length(_digits(body))
    if kind == "ip":
        return body.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when((n < 14) | (n > 19), False).otherwise(_luhn(body))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(items: Column, state: dict[str, Column], empty: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column | None, Column]]) -> Column:
    """A fold over an array that emits elements of the array type `empty`: step gives the new state, whether to emit (None:
    always) and what.

    Elements are folded in blocks and a block's output is a short array of its own, so no array grows step by step.
    """
    none, nested = (F.expr(f"cast(array() as {t})") for t in (empty, f"array<{empty}>"))
    held = lambda s, out: F.struct(*[s[k].alias(k) for k in state], out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        new, when, value = step(s, x)
        more = F.concat(s["out"], F.array(value))
        return held(new, more if when is None else F.when(when, more).otherwise(s["out"]))

    def block(s: Column, xs: Column) -> Column:
        return F.aggregate(xs, held(s, none), one, lambda r: held(r, F.concat(s["out"], F.array(r["out"]))))

    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / BLOCK).cast("int")), lambda k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK)))
    return F.flatten(F.aggregate(_once(items, cut), held(state, nested), block, lambda s: s["out"]))


def _located(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Every leftmost match with its code points: the pieces between matches tell where each begins and what is around."""
    tail = lambda *x: F.call_function("substring", F.concat(*x), F.lit(-AROUND), F.lit(AROUND))

    def spans(both: Column) -> Column:
        m, p = both["m"], both["p"]
        rest = lambda x: F.slice(x, F.lit(2), F.size(p))
        items = F.slice(F.arrays_zip(m.alias("m"), p.alias("p"), rest(m).alias("next_m"), rest(p).alias("next_p")), F.lit(1), F.size(m))

        def step(s: Column, x: Column) -> tuple[dict[str, Column], Column | None, Column]:
            begin = s["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            first = lambda c: F.call_function("substring", c, F.lit(1), F.lit(1))
            right = F.coalesce(F.nullif(first(x["next_p"]), F.lit("")), first(x["next_m"]), F.lit(""))
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("body"), tail(s["tail"], x["p"]).alias("left"), right.alias("right"))
            return {"at": end, "tail": tail(s["tail"], x["p"], x["m"])}, _valid(kind, x["m"]) if base else None, span

        return _scan(items, {"at": F.lit(0), "tail": F.lit("")}, SPANS, step)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    likely = {"email": text.contains("@") if base else text.rlike("(?i)[ (\\[]at[ )\\]]"), "phone": text.contains("+") if base else text.rlike("[0-9]{3}[ .-][0-9]{4}")}.get(kind, text.rlike(pattern))
    return F.when(likely, _once(found, spans)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _sorted(spans: Column) -> Column:
    """By start, then kind, then end."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), x["kind"].alias("b"), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def _clear(base: Column, wider: Column) -> Column:
    """Spans of wider that overlap none of base: one pass forwards for the base spans before each, one backwards for those after."""
    marked = lambda spans, wide: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(wide).alias("wide"), x["end"].alias("end"), x.alias("x")))
    kind = f"array<struct<start:int,wide:int,end:int,x:{SPANS[6:-1]},reach:int>>"

    def forward(s: Column, y: Column) -> tuple[dict[str, Column], Column | None, Column]:
        reach = F.when(y["wide"] == 0, F.greatest(s["reach"], y["end"])).otherwise(s["reach"])
        return {"reach": reach}, None, F.struct(y["start"].alias("start"), y["wide"].alias("wide"), y["end"].alias("end"), y["x"].alias("x"), s["reach"].alias("reach"))

    def backward(s: Column, y: Column) -> tuple[dict[str, Column], Column | None, Column]:
        following = F.when(y["wide"] == 0, y["start"]).otherwise(s["next"])
        return {"next": following}, (y["wide"] == 1) & (y["reach"] <= y["start"]) & (s["next"] >= y["end"]), y["x"]

    passed = _scan(F.array_sort(F.concat(marked(base, 0), marked(wider, 1))), {"reach": F.lit(-1)}, kind, forward)
    clear = _scan(F.reverse(passed), {"next": F.lit((1 << 31) - 1)}, SPANS, backward)
    return F.when((F.size(base) == 0) | (F.size(wider) == 0), wider).otherwise(clear)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with `base` and `wider`: arrays of located spans; wider ones don't overlap base ones."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = _sorted(F.concat(*[_located(body, p, k, True) for k, p in BASE.items()]))
    wider = F.concat(*[_located(body, p, k, False) for k, p in WIDER.items()])
    found = docs.withColumn("base", base).withColumn("wider", wider).drop(text)
    return found.withColumn("wider", _sorted(_clear(F.col("base"), F.col("wider"))))


def _by_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in cases.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def votes(x: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 for, -1 against, 0 nothing."""
    kind, body, left, right = x["kind"], x["body"], x["left"], x["right"]
    say = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return {
        # regex
        "pattern": _by_kind(kind, {"email": say(body.contains("@"), ~body.rlike("(?i)[(\\[]")), "phone": say(body.startswith("+")), "secret": say(body.rlike("^AKIA[0-9A-Z]{16}$|[=:] ?\"?[0-9a-f]{16,}$"))}, F.lit(1)),
        "check": _by_kind(kind, {"email": say(~body.contains(".."), body.contains("..")), "phone": say(F.length(_digits(body)).between(10, 15), F.length(_digits(body)) < 10), "secret": say(F.length(body) >= 20, ~body.rlike("[0-9]"))}, F.lit(1)),
        # gazetteer
        "gazetteer": _by_kind(kind, {"email": say(body.rlike(DOMAINS)), "ip": say(F.lit(False), body.rlike(LOCAL_ADDRESSES)), "card": say(body.rlike(CARD_ISSUERS), ~body.rlike(CARD_ISSUERS)), "secret": say(body.rlike(CREDENTIAL_WORDS), body.contains(":") & ~body.contains("\""))}, F.lit(0)),
        # context
        "cue": _by_kind(kind, {k: say(left.rlike(p)) for k, p in CUES.items()}, F.lit(0)),
        "edges": say((left.rlike(r"(?:^|[\s(<\"':,])$")) & right.rlike(r"^(?:$|[\s)>\"',.;:!?])"), left.rlike(r"[A-Za-z0-9]$") | right.rlike(r"^[A-Za-z0-9]")),
        "shape": _by_kind(kind, {"secret": say(mixed, ~mixed), "phone": say(body.rlike(r"[ ()-]"))}, F.lit(0)),
    }


def features(x: Column) -> dict[str, Column]:
    """What the classifier sees of a span: yes or no."""
    body = x["body"]
    return {
        "long": F.length(body) >= 20,
        "digit": body.rlike("[0-9]"),
        "many_digits": 2 * F.length(_digits(body)) >= F.length(body),
        "mixed_case": body.rlike("[A-Z]") & body.rlike("[a-z]"),
        "quoted": body.rlike("\""),
        "assigned": body.rlike("="),
        "known": body.rlike(CREDENTIAL_WORDS) | body.rlike(DOMAINS),
        "apart": x["left"].rlike(r"(?:^|\s)$"),
        "ends": x["right"].rlike(r"^(?:$|\s|[.,;\"])"),
    }


def estimate(patterns: list[tuple[int, tuple[int, ...], int]]) -> dict[int, tuple[float, list[dict[int, tuple[float, float]]]]]:
    """EM for each kind: from counts of vote patterns to the share of true spans and, for each labeler, the chance of each vote on true and on other spans."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        believed = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * len(v)))) for v, _ in rows]
        for _ in range(ROUNDS):
            total = sum(n for _, n in rows)
            true = sum(p * n for p, (_, n) in zip(believed, rows, strict=True))
            share = (true + 1) / (total + 2)
            chance = [{s: ((sum(p * n for p, (v, n) in zip(believed, rows, strict=True) if v[j] == s) + 0.5) / (true + 1.5), (sum((1 - p) * n for p, (v, n) in zip(believed, rows, strict=True) if v[j] == s) + 0.5) / (total - true + 1.5)) for s in (-1, 0, 1)} for j in range(len(LABELERS))]
            # a labeler speaks for a span more often when it is true: keeps the two classes from trading places
            chance = [c if c[1][0] * c[-1][1] >= c[1][1] * c[-1][0] else {s: ((c[s][0] + c[s][1]) / 2,) * 2 for s in c} for c in chance]
            believed = [1 / (1 + math.exp(-max(-30.0, min(30.0, math.log(share / (1 - share)) + sum(math.log(chance[j][s][0] / chance[j][s][1]) for j, s in enumerate(v)))))) for v, _ in rows]
        out[kind] = share, chance
    return out


def _posterior(x: Column, model: dict) -> Column:
    said = votes(x)
    odds = F.lit(-30.0)
    for kind, (share, chance) in model.items():
        mine = F.lit(math.log(share / (1 - share)))
        for j, name in enumerate(LABELERS):
            w = {s: math.log(c[0] / c[1]) for s, c in chance[j].items()}
            mine = mine + F.when(said[name] == 1, w[1]).when(said[name] == -1, w[-1]).otherwise(w[0])
        odds = F.when(x["kind"] == kind, mine).otherwise(odds)
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))


def train(found: DataFrame) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """Per kind, the classifier: log odds to begin with, and for each feature what yes and no add."""
    spans = found.select(F.explode(F.concat("base", "wider")).alias("x"))
    x = F.col("x")
    said = votes(x)
    counts = spans.select(x["kind"].alias("kind"), *[said[n].alias(n) for n in LABELERS]).groupBy("kind", *LABELERS).count().collect()  # 5 x 3^6 rows at most
    model = estimate([(r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in counts])
    if not model:
        return {}
    p = spans.withColumn("p", _posterior(x, model))
    seen = features(x)
    sums = [F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")]
    for name, f in seen.items():
        sums += [F.sum(F.when(f, F.col("p")).otherwise(0.0)).alias(f"{name}_yes"), F.sum(F.when(f, 1 - F.col("p")).otherwise(0.0)).alias(f"{name}_no")]
    out = {}
    for r in p.groupBy(x["kind"].alias("kind")).agg(*sums).collect():
        rate = lambda a, n: (a + 1) / (n + 2)
        weights = [(math.log(rate(r[f"{f}_yes"], r["yes"]) / rate(r[f"{f}_no"], r["no"])), math.log((1 - rate(r[f"{f}_yes"], r["yes"])) / (1 - rate(r[f"{f}_no"], r["no"])))) for f in seen]
        out[r["kind"]] = math.log((r["yes"] + 1) / (r["no"] + 1)), weights
    return out


def _accepts(x: Column, classifier: dict) -> Column:
    seen = features(x)
    odds = F.lit(-1.0)
    for kind, (start, weights) in classifier.items():
        mine = F.lit(start)
        for (yes, no), f in zip(weights, seen.values(), strict=True):
            mine = mine + F.when(f, yes).otherwise(no)
        odds = F.when(x["kind"] == kind, mine).otherwise(odds)
    return odds > 0


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with `base` and `spans`: arrays of struct<start, end, kind, body, left, right> by start.

    kind indexes KINDS; start and end count code points, end exclusive.  spans holds base and the added spans.  Null and
    empty texts have none.  Repeated rows each get their own.  Columns named base, wider or spans are replaced.
    """
    found = written(candidates(docs.drop(*[c for c in ("base", "wider", "spans") if c != text]), text), "pii")
    classifier = train(found)
    added = F.filter("wider", lambda x: _accepts(x, classifier))
    return found.withColumn("spans", _sorted(F.concat("base", added))).drop("wider")


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
