"""Personal data: patterns whose matches always count, and boosted trees over what high-recall generators propose beside.

Everything that touches the corpus is a DataFrame expression, row by row, without a shuffle. The trees are small: they
are fitted with numpy on the driver, on SAMPLE drawn examples of each kind (fixed seed; the corpus has no labelled
spans), and become one constant of the plan. Each kind's threshold is calibrated on examples that the trees did not see: the
least score from which on the share of right proposals is PRECISION.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
SAMPLE, PRECISION, SEED = 3000, 0.99, 3
ROUNDS, RATE, DEPTH = 25, 0.3, 3
#: Code points of context that features see before a span.
CONTEXT = 28
#: Code points of the pieces that contexts are cut from; more than any proposal has.
PIECE = 512

#: Matches of a text that are placed together.
BLOCK = 128
#: Stands for a separator that joins two characters, so that a chain is a run of one class: no nested repetition, which
#: would recurse once a link. Where it occurs in a text it is taken for "~" first.
JOIN = ""
#: The base patterns over joined texts. A run that fails from its first character fails from every other, so matches are
#: only tried at its start (or where the last match ended); that keeps the scan linear.
LOCAL = f"A-Za-z0-9._%+{JOIN}-"
BASE = {
    "email": (f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (f"[0-9][0-9{JOIN}]++", r"(?<=[0-9])[\x20-](?=[0-9])"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", None),
}
#: What the generators propose, several a kind, so that proposals overlap: strings written unlike the base pattern, and
#: what a base match that failed as a whole may hold (two cards side by side, a phone with an address behind it). Bounded
#: repetitions only. Of equal scores the earlier generator's counts.
PROPOSE = {
    "email": [
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?[a-z0-9-]{1,63}(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\.)[a-z0-9-]{2,24}",
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20(?:at|@)\x20[a-z0-9-]{1,63}\x20(?:dot|\.)\x20[a-z]{2,24}(?![a-z0-9])",
    ],
    "ip": [
        r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20|,)[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20|[.,])[0-9]{1,3}(?:\[\.\]|\(\.\)|\x20\.\x20|[.,])[0-9]{1,3}(?![0-9])",
        r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[._/:-]{1,2}[0-9]{4,6}[._/:-]{1,2}[0-9]{4,5}(?:[._/:-]{1,2}[0-9]{1,4})?(?![0-9])",
    ],
    "phone": [
        r"\+[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4})?(?![0-9])",
        r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ],
}
#: Words that announce each kind (fixed values).
CUES = {
    "email": "mail|contact|write|reach|address|correo|kontakt|courriel|send",
    "ip": "ip|addr|host|server|login|from|dns|gateway|client",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay|cc",
    "phone": "phone|tel|call|mobile|cell|fax|handy|whatsapp|sms|dial|appel|anruf|contact|reach|number",
}
FEATURES = ["digits", "length", "groups", "cue", "bracket", "luhn", "octets", "zeros", "dots", "dashes", "slashes", "spaces", "word_before", "year", "plus", "word_after"]


def joined(text: Column, kind: str) -> Column:
    safe = F.translate(text, JOIN, "~")
    return safe if BASE[kind][1] is None else F.regexp_replace(safe, BASE[kind][1], JOIN)


def bind(x: Column, use) -> Column:
    """use(x) where x is computed once, however often use refers to it."""
    return F.transform(F.array(x), use)[0]


def scan(items: Column, state: Column, step, kind: str) -> Column:
    """array<kind> of what step(state, item) -> (state, out) gives for each item, in order.

    Appending copies, so items are taken in blocks, and blocks are put together at the end.
    """
    none, rows = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def blocks(p: Column) -> Column:
        last = F.greatest(F.floor((F.size(p) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK)))

    def one(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bind(done, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["rows"], r["out"]).alias("rows")))

    return F.aggregate(bind(items, blocks), F.struct(state.alias("state"), rows.alias("rows")), block, lambda acc: F.flatten(acc["rows"]))


MATCH = "struct<kind:int,start:int,end:int,hit:string,order:int>"


def generated(text: Column) -> Column:
    """array<MATCH> of the matches of all patterns, leftmost without overlaps for each; code points; order 0 for base patterns, then from -1 down.

    What splitting leaves between the matches and the matches themselves add up to the text, which gives their places. All
    patterns' matches are placed by the same expression, so the plan holds it once.
    """
    found = []
    for k, kind in enumerate(KINDS):
        need = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        more = text.rlike(r"(?i)(?:[\[({<]\x20?|\x20)(?:at|@)(?:\x20?[\])}>]|\x20)") if kind == "email" else text.rlike("[0-9]{2}")
        safe = F.translate(text, JOIN, "~")
        for order, (when, where, pattern) in enumerate([(need, joined(text, kind), BASE[kind][0]), *[(more, safe, p) for p in PROPOSE[kind]]]):
            both = F.struct(F.regexp_extract_all(where, F.lit(pattern), F.lit(0)).alias("hits"), F.split(where, pattern, -1).alias("gaps"))
            found.append(F.struct(F.lit(k).alias("kind"), F.lit(-order).alias("order"), F.when(when, both).alias("m")))

    def placed(g: Column) -> Column:
        pairs = F.filter(F.zip_with(g["m"]["hits"], g["m"]["gaps"], lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap"))), lambda x: x["hit"].isNotNull())

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["gap"])
            end = start + F.length(x["hit"])
            return end, F.struct(g["kind"].alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"), g["order"].alias("order"))

        return scan(pairs, F.lit(0), step, MATCH)

    return F.flatten(F.transform(F.filter(F.array(*found), lambda g: F.size(g["m"]["hits"]) > 0), placed))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def octets(x: Column, separators: str = r"\.") -> Column:
    """Whether all numbers between separators are at most 255."""
    return F.forall(F.split(x, separators), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": octets,
    "card": lambda x: F.when(F.length(digits(x)).between(13, 19), luhn(digits(x))).otherwise(False),
    "phone": lambda x: F.length(digits(x)).between(9, 15),
}


def of_kind(kind: Column, values) -> Column:
    """values[kind] by a kind's place in KINDS; values: columns."""
    out = F.when(kind == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(kind == k, v)
    return out


def features_of(hit: Column, before: Column, after: Column, kind: str | Column) -> dict[str, Column]:
    """The features of a span of a kind, which may be given as a column of its place in KINDS."""
    d = digits(hit)
    cue = [F.lower(before).rlike(f"(?:{CUES[k]})") for k in ([kind] if isinstance(kind, str) else KINDS)]
    count = lambda c: F.length(hit) - F.length(F.translate(hit, c, ""))
    return {
        "digits": F.length(d),
        "length": F.length(hit),
        "groups": F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))),
        "cue": (cue[0] if isinstance(kind, str) else of_kind(kind, cue)).cast("int"),
        "bracket": hit.rlike(r"[(\[{<]").cast("int"),
        "luhn": F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False).cast("int"),
        "octets": F.forall(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)).cast("int"),
        "zeros": hit.startswith("00").cast("int"),
        "dots": count("."),
        "dashes": count("-"),
        "slashes": count("/:_,"),
        "spaces": count(" "),
        "word_before": before.rlike(r"[\p{L}0-9_./:-]$").cast("int"),
        "year": hit.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("int"),
        "plus": hit.startswith("+").cast("int"),
        "word_after": after.rlike(r"^(?:[\p{L}0-9_@/]|[.,:-][\p{L}0-9])").cast("int"),
    }


# --- the trees: drawn examples, gradient boosting, CASE expressions


def plain_features(hit: str, before: str, after: str, kind: str) -> list[float]:
    """The same features of an example, on the driver."""
    import re

    groups = re.findall("[0-9]+", hit)
    d = "".join(groups)
    check = sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return [
        len(d), len(hit), len(groups), int(bool(re.search(CUES[kind], before.lower()))), int(bool(re.search(r"[(\[{<]", hit))), int(13 <= len(d) <= 19 and check),
        int(all(len(g) <= 3 and int(g) <= 255 for g in groups)), int(hit.startswith("00")), hit.count("."), hit.count("-"), sum(map(hit.count, "/:_,")), hit.count(" "),
        int(bool(re.search(r"[^\W]$|[./:-]$", before))), int(bool(re.search(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)", hit))),
        int(hit.startswith("+")), int(bool(re.search(r"^(?:[^\W]|[@/]|[.,:-][^\W_])", after))),
    ]


def drawn_examples(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of strings that the kind's generator would propose, personal data or not."""
    r = random.Random(f"{kind}{seed}")
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    cues = CUES[kind].split("|")

    def card(sep: str) -> str:
        d = r.choice("3456") + num(14)
        for c in "0123456789":
            x = d + c
            if sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(map(int, reversed(x)))) % 10 == 0:
                return sep.join(x[i : i + 4] for i in range(0, 16, 4))
        raise AssertionError

    def positive() -> str:
        if kind == "email":
            a, b = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", " [dot] "), ("{at}", "."), ("<at>", "<dot>"), (" at ", " dot ")])
            return word() + r.choice(["", ".", "_"]) + word() + a + word() + b + r.choice(["com", "org", "net", "de", "fr", "io"])
        if kind == "ip":
            a = r.choice(["[.]", "(.)", " . ", "."])
            return a.join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return card(r.choice(["", "", " ", ".", "/", "_", "--", "-", ":"]))
        s = r.choice([" ", "-", ".", "-", " "])
        if r.random() < 0.35:
            return r.choice([f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 99)}{s}{num(3)}{s}{num(3)}{s}{num(4)}", f"+{r.randint(1, 99)}{s}{num(2)}{s}{num(4)}{s}{num(4)}"])
        return r.choice([f"({num(3)}){s}{num(3)}{s}{num(4)}", f"{num(3)}{s}{num(3)}{s}{num(4)}", f"00{r.randint(1, 99)}{s}{num(3)}{s}{num(3)}{s}{num(4)}", f"0{num(3)}/{num(3)}{num(4)}", f"0{num(2)}{s}{num(4)}{s}{num(4)}"])

    def negative() -> str:
        if kind == "email":
            return r.choice([f"{word()} (at) {word()}.{word()}", f"{word()}(at){num(2)}.{num(3)}", f"{num(3)}[.]{num(2)}"]) if r.random() < 0.5 else f"{num(2)} (at) {num(2)}.{num(2)}"
        if kind == "ip":
            return r.choice([",".join(str(r.randint(0, 999)) for _ in range(4)), ",".join(str(r.randint(0, 255)) for _ in range(4)), "[.]".join(str(r.randint(256, 999)) for _ in range(4)), ".".join(str(r.randint(0, 999)) for _ in range(4))])
        if kind == "card":
            s = r.choice([".", "/", "_", "-", ":"])
            if r.random() < 0.4:
                return r.choice([num(r.randint(13, 19)), " ".join(num(4) for _ in range(4))])
            return r.choice([s.join(num(4) for _ in range(4)), f"{num(4)}-{num(4)}-{num(4)}", f"20{num(2)}/{num(4)}/{num(4)}", f"{num(4)}:{num(6)}:{num(5)}"])
        y = f"{r.choice(['19', '20'])}{num(2)}"
        return r.choice([f"{y}-{num(3)}-{num(2)}", f"{num(2)}/{y}/{num(2)}", f"{num(2)} {num(3)} {num(3)}", f"{num(5)}-{num(4)}-{num(4)}-{num(2)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(5)} {num(3)} {num(2)}", f"{num(2)}-{num(4)} {num(3)}", f"{y} {num(3)} {num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(4)}-{y}"])

    rows, labels = [], []
    for _ in range(n):
        y = r.random() < 0.5
        hit = positive() if y else negative()
        cued = r.random() < (0.6 if y else 0.05)
        cue = f"{r.choice(cues)}{r.choice([':', '', ' at', ' no.'])}" if cued else r.choice([word(), word() + ",", word() + ".", num(r.randint(3, 16))])
        clear = r.random() < (0.97 if y else 0.6)  # parted from what stands beside it
        before = f"{word()} {cue}" + (" " if clear else r.choice(["#", "/", "v", "-", "=", "", "."]))
        after = r.choice(["", " ", ",", ".", ". ", ")", "\n", " 12", " " + word()]) if r.random() < (0.97 if y else 0.6) else r.choice([".1", "-22", word(), "/3", ":80"])
        if y and not (clear and plain_features(hit, before, after, kind)[-1] == 0) and not cued:
            y = False  # part of something longer
        if kind == "phone" and y and not cued and not hit.startswith(("(", "00", "+")):
            y = False  # digits alone, with nothing said about them, aren't personal data
        if kind == "card" and not y and clear:
            f = plain_features(hit, before, after, kind)
            y = f[5] and not f[-1]  # some pass the check by chance, and are taken for cards as the base pattern takes them
        rows.append(plain_features(hit, before, after, kind))
        labels.append(int(y))
    return np.array(rows, float), np.array(labels, float)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting with logistic loss: prior, and trees ((feature, cut, below, above) or a leaf's value)."""
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees = np.full(len(y), prior), []
    binned = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        leaf = float(RATE * total_g / (total_h + 1))
        if depth == 0 or len(at) < 20:
            return leaf
        best = (1e-3, None, None)
        for f, (values, place) in enumerate(binned):
            here = np.bincount(place[at], minlength=len(values)) > 0
            gl, hl = (np.cumsum(np.bincount(place[at], w[at], len(values))[here])[:-1] for w in (g, h))
            if not len(gl):
                continue
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            if gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float(values[here][k : k + 2].mean()))
        if best[1] is None:
            return leaf
        _, f, cut = best
        low = x[at, f] < cut
        return f, cut, grow(at[low], g, h, depth - 1), grow(at[~low], g, h, depth - 1)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
        score = score + walk(trees[-1], x)
    return prior, trees


def walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] < cut, walk(low, x), walk(high, x))


@lru_cache(maxsize=8)
def fitted(kind: str) -> tuple[float, list, float]:
    """Prior, trees and calibrated threshold of a kind."""
    prior, trees = boost(*drawn_examples(kind, SAMPLE, SEED))
    x, y = drawn_examples(kind, SAMPLE, SEED + 1)
    score = prior + sum(walk(t, x) for t in trees)
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.flatnonzero((right >= PRECISION) & np.append(np.diff(score[order]) < 0, True))  # ties stay together
    return prior, trees, float(score[order][ends[-1]]) if len(ends) else np.inf


def flat(tree) -> list[float]:
    """A tree as numbers: the features and the cuts of its DEPTH levels of nodes, level by level, then its leaves."""
    features, cuts, level = [], [], [tree]
    for _ in range(DEPTH):
        nodes = [t if isinstance(t, tuple) else (0, 0.0, t, t) for t in level]
        features += [float(n[0]) for n in nodes]
        cuts += [float(n[1]) for n in nodes]
        level = [x for n in nodes for x in n[2:]]
    return features + cuts + [float(x) for x in level]


def score_of(x: Column, kind: Column) -> Column:
    """The score of a span by its kind's trees; x: array<double> of its FEATURES.

    The trees are one constant of the plan, and one expression walks them all.
    """
    models = [fitted(k) for k in KINDS]
    trees = F.expr("array(" + ", ".join("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in flat(t)) + ")" for t in m[1]) + ")" for m in models) + ")")
    inner = 2**DEPTH - 1

    def leaf(t: Column) -> Column:
        at = F.lit(0)
        for _ in range(DEPTH):
            right = F.get(x, F.get(t, at).cast("int")) >= F.get(t, at + inner)
            at = at * 2 + F.when(right, 2).otherwise(1)
        return F.get(t, at + inner)  # the leaves stand behind features and cuts: place at - inner of them

    return F.aggregate(F.get(trees, kind), of_kind(kind, [F.lit(float(m[0])) for m in models]), lambda acc, t: acc + leaf(t))


SCORED = "struct<kind:int,start:int,end:int,score:double,order:int>"


def accepted(text: Column, proposals: Column) -> Column:
    """array<SCORED> of the proposals (array<MATCH>) whose score reaches the kind's threshold; of those of a kind that overlap, the better ones."""

    def seen(pieces: Column, m: Column) -> Column:
        """A proposal with what stands before and after it, from the pieces of the text around its start: a long text isn't walked for each."""
        at = F.floor(m["start"] / PIECE).cast("int")
        near = F.concat(*[F.coalesce(F.get(pieces, at + k), F.lit("")) for k in (-1, 0, 1)])
        skipped = F.greatest(at - 1, F.lit(0)) * PIECE
        first = F.greatest(m["start"] - CONTEXT, F.lit(0))
        return bind(near, lambda n: F.struct(m.alias("m"), F.substring(n, first - skipped + 1, m["start"] - first).alias("before"), F.substring(n, m["end"] - skipped + 1, F.lit(2)).alias("after")))

    def features(s: Column) -> Column:
        m = s["m"]
        f = features_of(m["hit"], s["before"], s["after"], m["kind"])
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["order"].alias("order"), F.array(*[f[k].cast("double") for k in FEATURES]).alias("x"))

    def score(m: Column) -> Column:
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score_of(m["x"], m["kind"]).alias("score"), m["order"].alias("order"))

    least = lambda kind: of_kind(kind, [F.lit(float(fitted(k)[2])) for k in KINDS])
    pieces = F.when(F.size(proposals) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    placed = bind(pieces, lambda p: F.transform(proposals, lambda m: seen(p, m)))
    good = F.filter(F.transform(F.transform(placed, features), score), lambda m: m["score"] >= least(m["kind"]))
    rank = lambda m: F.struct(m["score"], m["order"], -m["start"])

    def keep(last: Column, m: Column) -> tuple[Column, Column]:
        apart = last.isNull() | (last["kind"] != m["kind"]) | (last["end"] <= m["start"])
        return F.when(apart | (rank(m) > rank(last)), m).otherwise(last), F.when(apart, last)

    end = F.lit(None).cast("struct<kind:int>").isNull()  # what comes behind all gives the last one out
    stop = F.when(end, F.struct(F.lit(len(KINDS)).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("order")))
    kept = scan(F.array_append(F.array_sort(good), stop), F.lit(None).cast(SCORED), keep, SCORED)
    return F.filter(kept, lambda m: m.isNotNull())


PLACED = "struct<start:int,own:int,end:int,kind:int>"


def beside(base: Column, more: Column) -> Column:
    """array<PLACED> of all base spans (own 0) and of those of more (own 1) that overlap none of them: a sweep forward and one back."""
    as_placed = lambda a, own: F.transform(a, lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m["end"].alias("end"), m["kind"].alias("kind")))
    some = lambda a: F.filter(a, lambda m: m.isNotNull())
    both = F.array_sort(F.concat(as_placed(base, 0), as_placed(more, 1)))
    is_base = lambda m: m["own"] == 0
    clear = scan(both, F.lit(0), lambda reach, m: (F.when(is_base(m), F.greatest(reach, m["end"])).otherwise(reach), F.when(is_base(m) | (m["start"] >= reach), m)), PLACED)
    back = scan(F.reverse(some(clear)), F.lit(2**31 - 1), lambda first, m: (F.when(is_base(m), F.least(first, m["start"])).otherwise(first), F.when(is_base(m) | (m["end"] <= first), m)), PLACED)
    return F.when(F.size(more) == 0, as_placed(base, 0)).otherwise(some(back))


def _base_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every row of docs; spans: array of (kind, start, end, base) by kind as listed, then start.

    Places are code points, end exclusive. base: a match of the kind's base pattern that is valid (an ip's parts at most
    255, a card's 13 to 19 digits passing Luhn, a phone's 9 to 15 digits). The rest are proposals that the trees accept;
    one that overlaps a base span of any kind is left out. Null texts count as empty: no spans, and text stays null. Ids
    may be null or repeat. An empty table gives no rows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", generated(t).alias("m"))
    valid = lambda m: of_kind(m["kind"], [VALID[k](m["hit"]) for k in KINDS])
    rows = rows.select("doc_id", "text", F.filter("m", lambda m: (m["order"] == 0) & valid(m)).alias("base"), bind(F.filter("m", lambda m: m["order"] < 0), lambda p: accepted(t, p)).alias("more"))
    rows = rows.select("doc_id", "text", beside(F.col("base"), F.col("more")).alias("s"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.transform("s", lambda m: F.struct(m["kind"], m["start"], m["end"], m["own"] == 0))), lambda m: F.struct(F.get(names, m["kind"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["col4"].alias("base")))
    return rows.select("doc_id", "text", spans.cast(SPANS).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """find()'s rows as counts and strings: doc_id, n_<kind> of base spans, base_sha256, spans."""
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [_base_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; of overlapping spans the first to start covers the rest."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return find(docs).select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))
