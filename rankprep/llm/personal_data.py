"""Personal data by weak supervision; DataFrame and SQL functions only.

Patterns find the base kinds. Further candidates (values of keywords, long mixes of letters and digits, names, addresses)
are judged by labelers, each a pattern, a gazetteer or a look at the words around, that vote yes or no or abstain. The
votes of all documents are counted by combination; expectation-maximisation on these counts estimates how reliable each
labeler is, and its posteriors train a small classifier for each kind on what the candidates look like, which then
decides about every span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns. Possessive runs and looks behind spare the engine hopeless starts and, where a
#: group repeats, the recursion that long matches would end in.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_IP_PART = r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: A whole run of digits with single separators that has 16 to 19 digits; shorter and longer runs fail as wholes.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Elements that a running sum takes at a time.
STEP = 512
#: Code points of context that labelers see on either side.
CONTEXT = 32


# ---- arrays without quadratic work -----------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element, what ``add`` makes of ``zero`` and all elements before it; in steps, as appending copies."""
    some = lambda x: F.array(x).cast(f"array<{kind}>")
    grow = lambda acc, x: F.array_append(acc, add(F.element_at(acc, -1), x))

    def steps(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: F.slice(v, i * STEP + 1, STEP))

    def within(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda part: F.aggregate(part, zero, add)), some(zero), grow)
        each = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, start: F.slice(F.aggregate(part, some(start), grow), F.lit(1), F.size(part)))
        return F.flatten(each)

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(steps(v), within)).otherwise(F.array().cast(f"array<{kind}>")))


_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def spans_of(text: Column, pattern: str, hint: str = "") -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost non-overlapping matches, in code points, end
    exclusive; the context ends at the matches beside it. Texts without ``hint`` have none."""
    size = lambda x: F.length(x["gap"]) + F.length(x["value"])

    def placed(gaps: Column, found: Column) -> Column:
        after = F.slice(gaps, F.lit(2), F.size(found))
        pairs = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value"))), after, lambda x, g: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), g.alias("next")))

        def spans(x: Column) -> Column:
            at = running(F.transform(x, size), F.lit(0), lambda p, q: p + q)
            return F.zip_with(x, at, lambda m, n: F.struct((n + F.length(m["gap"])).alias("start"), (n + size(m)).alias("end"), m["value"].alias("value"), F.right(m["gap"], F.lit(CONTEXT)).alias("before"), F.left(m["next"], F.lit(CONTEXT)).alias("after")))

        return _let(pairs, spans)

    found = _let(F.split(text, pattern, -1), lambda gaps: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: placed(gaps, m)))
    some = text.rlike(pattern)
    return F.when(F.contains(text, F.lit(hint)) & some if hint else some, found.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)

    def worth(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int") * (1 + (i + 1) % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), worth), F.lit(0), lambda a, x: a + x)
    return (F.length(d) > 0) & (total % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind; matches that fail their check are dropped without another try."""
    n_digits = lambda x: F.length(_digits(x["value"]))
    return {
        "email": spans_of(text, _EMAIL, "@"),
        "ip": F.filter(spans_of(text, _IP, "."), lambda x: x["value"].rlike(_IP_PART)),
        "card": F.filter(spans_of(text, _CARD), lambda x: _luhn(x["value"])),
        "phone": F.filter(spans_of(text, _PHONE, "+"), lambda x: (n_digits(x) >= 8) & (n_digits(x) <= 15)),
    }


def _share(value: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{cls}]", "")) / F.length(value)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 yes, 0 no, 2 abstains."""
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, 0)).otherwise(2)


def _bin(*cases: Column) -> Column:
    """The number of the first case that holds; the count of cases if none does."""
    out = F.lit(len(cases))
    for i, case in reversed(list(enumerate(cases))):
        out = F.when(case, i).otherwise(out)
    return out


# ---- the added kinds: candidates, labelers and features --------------------------------------------------------------

#: Words before credentials, the first letters of well-known ones, words before harmless numbers.
_KEYWORDS = r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth|credentials?|bearer|private[_-]?key)"
_PREFIXES = r"^(?:AKIA|ASIA|AGPA|AIDA|AROA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|pk-|rk_|xox[abprs]-|AIza|ya29|eyJ|SG\.|SG-)"
_HARMLESS = r"(?i)(?:version|release|isbn|doi|section|figure|table|chapter|page|build|rfc|iso|http\S*|www\S*)[\s.:#/-]*$"
_KEYWORD = _KEYWORDS + r"[\"']?\s*(?:[=:]|=>|is)?\s*[\"']?$"
_ASSIGNED = r"[=:]\s*[\"']?$"
#: The value of a keyword, whatever it is made of, after its sign; or 12 characters or more, with letters and three digits.
_SECRET = (
    r"(?:(?=[=:])(?<=" + _KEYWORDS + r"[\"']?\s{0,3})(?:=>|[=:])\s{0,3}[\"']?[^\s\"'<>,;=:][^\s\"'<>,;]{3,}+"
    r"|(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{12})(?=[0-9_-]*+[A-Za-z])(?=(?:[A-Za-z_-]*+[0-9]){3})[A-Za-z0-9_-]++)"
)
_SIGN = r"^(?:=>|[=:])\s{0,3}[\"']?"
#: Given names, words before names, and first words that begin no name.
_GIVEN = (
    "Alice|Andreas|Andrew|Anna|Anne|Antonio|Barbara|Carlos|Carmen|Catherine|Charles|Charlotte|Christian|Christine|Claire|Claudia|Daniel|David|Diego|Elena|"
    "Elizabeth|Emily|Emma|Eva|Francisco|Frank|George|Hans|Helen|Isabelle|James|Jean|Jennifer|Jessica|Johann|John|Jorge|José|Joseph|Juan|Julia|Karl|Klaus|Laura|Linda|"
    "Louis|Lucas|Luis|Manuel|Marco|Maria|María|Marie|Mark|Martin|Mary|Michael|Michel|Nicolas|Olivia|Patricia|Paul|Pedro|Peter|Philippe|Pierre|Richard|Robert|"
    "Sarah|Sophie|Stefan|Susan|Thomas|Ursula|William|Wolfgang"
)
_TITLE = r"\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Señora?)\.?\s$"
_NAMED = r"(?i)\b(?:name|contact|dear|sincerely|regards|signed|attn|from|nombre|nom)\b[:,]?\s*$"
_NO_NAME = r"^(?:The|This|That|These|Those|When|Where|What|There|Then|They|We|You|Our|Your|For|From|With|Der|Die|Das|Ein|Eine|Le|La|Les|Un|Une|El|Los|Las)\b"
_WORD = r"\p{Lu}\p{Ll}++"
_NAME = (
    r"(?<![\p{L}\p{N}_])(?=\p{Lu}\p{Ll})(?:(?=(?:" + _GIVEN + r")(?![\p{L}]) )|(?<=\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sra?|Señora?)\.? )"
    r"|(?<=\b(?i:name|contact|dear|sincerely|regards|signed|attn)[:,] ))" + _WORD + r"(?:[ -]" + _WORD + r"){0,3}+(?![\p{L}\p{N}_])"
)
#: Kinds of streets, words before addresses, and large cities.
_STREET = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way"
_LIVES = r"(?i)\b(?:address|lives?|living|resid(?:es|ing)|located|at|adresse|dirección|wohnt|habite)\b[:,]?\s*(?:at|in)?\s*$"
_CITY = r"\b(?:Amsterdam|Barcelona|Berlin|Boston|Chicago|Dallas|Frankfurt|Hamburg|Houston|London|Los Angeles|Lyon|Madrid|Marseille|Miami|München|Munich|New York|Paris|San Francisco|Seattle|Sevilla|Toronto|Valencia|Vienna|Wien|Zürich)\b"
_ADDRESS = (
    r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}[A-Za-z]? (?:" + _WORD + r" ){1,3}(?:" + _STREET + r")(?![\p{L}])\.?"
    r"|" + _WORD + r"(?:straße|strasse|gasse|allee|platz) [0-9]{1,4}[a-z]?(?![\p{L}\p{N}]))"
)


@dataclass(frozen=True)
class Kind:
    """An added kind: where candidates are, how labelers vote on them, and bins of what they look like (with their numbers)."""

    name: str
    pattern: str
    votes: Callable[[Column, Column, Column], list[Column]]
    features: Callable[[Column, Column, Column], list[tuple[Column, int]]]
    lead: str = ""  # what matches before the candidate itself


def _secret_votes(value: Column, before: Column, after: Column) -> list[Column]:
    digits = _share(value, "0-9")
    return [
        _vote(value.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20})$"), value.rlike(r"^[a-z]+-?[0-9]{0,4}$")),
        _vote((digits >= 0.15) & (digits <= 0.85) & (F.length(value) >= 16), (F.length(value) < 14) & ~value.rlike(r"[^A-Za-z0-9_-]")),
        _vote(value.rlike(_PREFIXES)),
        _vote(before.rlike(_KEYWORD), before.rlike(_HARMLESS)),
        _vote(before.rlike(_ASSIGNED)),
        _vote(value.rlike("[a-z]") & value.rlike("[A-Z0-9]") & value.rlike("[0-9+/!@#$%^&*]"), value.rlike(r"^[0-9]+(?:[-_][A-Za-z0-9]+)*$") & (digits > 0.9)),
    ]


def _secret_features(value: Column, before: Column, after: Column) -> list[tuple[Column, int]]:
    n, digits = F.length(value), _share(value, "0-9")
    return [
        (_bin(n < 8, n < 16, n < 24, n < 40), 5),
        (_bin(digits == 0, digits < 0.2, digits < 0.5), 4),
        (_bin(~value.rlike("[A-Z]"), ~value.rlike("[a-z]")), 3),
        (_bin(before.rlike(_KEYWORD), before.rlike(_HARMLESS)), 3),
        (_bin(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), value.rlike("[^A-Za-z0-9_-]")), 3),
    ]


def _name_votes(value: Column, before: Column, after: Column) -> list[Column]:
    return [
        _vote(value.rlike(f"^(?:{_GIVEN})(?!\\p{{L}})"), value.rlike(_NO_NAME)),
        _vote(before.rlike(_TITLE)),
        _vote(before.rlike(_NAMED)),
        _vote(value.rlike("[ -]"), ~value.rlike("[ -]")),
        _vote(after.rlike(r"^,? (?:\(|born|said|wrote|lives|Jr|Sr)|^\s*$|^\n"), after.rlike(r"^,? (?:Street|St|Avenue|University|Institute|Inc|Ltd|GmbH|Company|Corporation|School|College|Hospital)\b")),
    ]


def _name_features(value: Column, before: Column, after: Column) -> list[tuple[Column, int]]:
    words = F.size(F.split(value, "[ -]"))
    return [
        (_bin(value.rlike(f"^(?:{_GIVEN})(?!\\p{{L}})"), value.rlike(_NO_NAME)), 3),
        (_bin(before.rlike(_TITLE), before.rlike(_NAMED)), 3),
        (_bin(words == 1, words == 2), 3),
    ]


def _address_votes(value: Column, before: Column, after: Column) -> list[Column]:
    return [
        _vote(before.rlike(_LIVES)),
        _vote(after.rlike(r"^,?\s*(?:[\p{L} ]{0,20},?\s*)?(?:[A-Z]{2}\s*)?[0-9]{5}(?![0-9])")),
        _vote(after.rlike(r"^,?\s*(?:[0-9]{4,5}\s+)?" + _CITY)),
        _vote(value.rlike(r"^[0-9]{1,4} .*(?:Street|Avenue|Road|Lane|Drive|Boulevard)"), value.rlike(r"^(?:19|20)[0-9]{2} ")),
        _vote(value.rlike(r"(?:straße|strasse|gasse|allee)"), value.rlike(r"^[0-9]+ .* (?:Way|Court|Square)$")),
    ]


def _address_features(value: Column, before: Column, after: Column) -> list[tuple[Column, int]]:
    return [
        (_bin(before.rlike(_LIVES)), 2),
        (_bin(after.rlike(r"^.{0,24}[0-9]{5}(?![0-9])"), after.rlike(_CITY)), 3),
        (_bin(value.rlike(r"^(?:19|20)[0-9]{2} "), value.rlike(r"^[0-9]")), 3),
    ]


ADDED = (Kind("secret", _SECRET, _secret_votes, _secret_features, _SIGN), Kind("name", _NAME, _name_votes, _name_features), Kind("address", _ADDRESS, _address_votes, _address_features))


def candidate_spans(text: Column, taken: Column, kind: Kind) -> Column:
    """Spans of candidates that overlap no span of ``taken``."""
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    def free(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.lit(0), lambda p, q: F.greatest(p, q))
        starts = running(F.reverse(F.transform(rows, lambda x: F.when(x["own"], 2**31 - 1).otherwise(x["start"]))), F.lit(2**31 - 1), lambda p, q: F.least(p, q))
        placed = F.zip_with(F.zip_with(rows, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), F.reverse(starts), lambda y, s: F.struct(y["x"].alias("x"), y["e"].alias("e"), s.alias("s")))
        kept = F.filter(placed, lambda y: y["x"]["own"] & (y["e"] <= y["x"]["start"]) & (y["s"] >= y["x"]["end"]))
        return F.transform(kept, lambda y: F.struct(*[y["x"][c].alias(c) for c in ("start", "end", "value", "before", "after")])).cast(_SPANS)

    def trimmed(x: Column) -> Column:
        lead = F.regexp_extract(x["value"], kind.lead, 0)
        value = F.substring(x["value"], F.length(lead) + 1, F.length(x["value"]))
        return F.struct((x["start"] + F.length(lead)).alias("start"), x["end"].alias("end"), value.alias("value"), F.concat(x["before"], lead).alias("before"), x["after"].alias("after"))

    found = spans_of(text, kind.pattern)
    found = F.transform(found, trimmed).cast(_SPANS) if kind.lead else found
    return _let(found, lambda x: F.when((F.size(x) > 0) & (F.size(taken) > 0), _let(F.array_sort(F.concat(mark(x, True), mark(taken, False))), free)).otherwise(x))


@dataclass
class SpanModel:
    """What was learned of a kind: P(vote | truth) by labeler, the share of true spans, the classifier's weights by bin."""

    reliability: list[list[list[float]]]
    prior: float
    bias: float
    weights: list[list[float]]

    def accepts(self, kind: Kind) -> Callable[[Column], Column]:
        def accepted(x: Column) -> Column:
            score = F.lit(self.bias)
            for (column, _), own in zip(kind.features(x["value"], x["before"], x["after"]), self.weights, strict=True):
                score = score + F.element_at(F.array(*[F.lit(w) for w in own]), column + 1)
            return score >= 0

        return accepted


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[list[list[list[float]]], float, dict[tuple[int, ...], float]]:
    """P(vote | truth) of each labeler, P(true), and P(true | votes), from how often each combination of votes occurs."""
    post = {v: (0.3 + sum(x == 1 for x in v)) / (1 + sum(x != 2 for x in v)) for v in counts}  # without votes: hardly
    n = len(next(iter(counts)))
    reliability: list[list[list[float]]] = []
    prior = 0.5
    for _ in range(rounds):
        total = sum(counts.values())
        prior = min(0.99, max(0.01, sum(c * post[v] for v, c in counts.items()) / total))
        reliability = []
        for j in range(n):
            table = [[1.0] * 3, [1.0] * 3]  # smoothed; [false, true][vote]
            for v, c in counts.items():
                table[1][v[j]] += c * post[v]
                table[0][v[j]] += c * (1 - post[v])
            reliability.append([[x / sum(row) for x in row] for row in table])
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(reliability[j][1][x] / reliability[j][0][x]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return reliability, prior, post


def _logistic(rows: list[tuple[tuple[int, ...], float, float]], n_bins: list[int], steps: int = 400) -> tuple[float, list[list[float]]]:
    """Bias and weights by bin, from (bins, count, share true)."""
    total = sum(c for _, c, _ in rows)
    bias, weights = 0.0, [[0.0] * b for b in n_bins]
    for _ in range(steps):
        gb, gw = 0.0, [[0.002 * w for w in own] for own in weights]
        for bins, c, p in rows:
            z = bias + sum(w[b] for w, b in zip(weights, bins, strict=True))
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * c / total
            gb += g
            for own, b in zip(gw, bins, strict=True):
                own[b] += g
        bias -= 2.0 * gb
        weights = [[w - 2.0 * g for w, g in zip(a, b, strict=True)] for a, b in zip(weights, gw, strict=True)]
    return bias, weights


def _found(text: Column) -> Column:
    """Struct of the spans of the base kinds and the candidates of the added ones; each is worked out once."""
    base = F.struct(*[c.alias(k) for k, c in base_spans(text).items()])

    def more(b: Column) -> Column:
        taken = F.concat(*[b[k] for k in KINDS])
        added = _let(taken, lambda t: F.struct(*[candidate_spans(text, t, k).alias(k.name) for k in ADDED]))
        return _let(added, lambda c: F.struct(*[b[k].alias(k) for k in KINDS], *[c[k.name].alias(k.name) for k in ADDED]))

    return _let(base, more)


def fit(docs: DataFrame) -> dict[str, SpanModel]:
    """Learns from the candidates of all documents, each added kind by itself; kinds without candidates get no model.

    What reaches the driver is one count for each combination of votes and bins, of which there are a fixed number.
    """
    each = _let(_found(F.coalesce("text", F.lit(""))), lambda m: F.concat(*[F.transform(m[k.name], _told(k)) for k in ADDED]))
    rows = docs.select(F.explode(each).alias("t")).groupBy("t").count().collect()
    models = {}
    for k in ADDED:
        own = sorted((tuple(r["t"]["votes"]), tuple(r["t"]["bins"]), float(r["count"])) for r in rows if r["t"]["kind"] == k.name)
        if own:
            counts: dict[tuple[int, ...], float] = {}
            for vote, _, n in own:
                counts[vote] = counts.get(vote, 0.0) + n
            reliability, prior, post = expectation_maximisation(counts)
            n_bins = [n for _, n in k.features(F.lit(""), F.lit(""), F.lit(""))]
            models[k.name] = SpanModel(reliability, prior, *_logistic([(bins, n, post[vote]) for vote, bins, n in own], n_bins))
    return models


def _told(kind: Kind) -> Callable[[Column], Column]:
    """The votes on a candidate and its bins."""

    def told(x: Column) -> Column:
        votes = kind.votes(x["value"], x["before"], x["after"])
        bins = [c for c, _ in kind.features(x["value"], x["before"], x["after"])]
        return F.struct(F.lit(kind.name).alias("kind"), F.array(*votes).cast("array<int>").alias("votes"), F.array(*bins).cast("array<int>").alias("bins"))

    return told


def find_personal_data(docs: DataFrame, models: dict[str, SpanModel], spans: str = "pii_spans") -> DataFrame:
    """``docs`` with the column ``spans``, array<struct<kind, start, end>> by kind (base kinds as listed, then the added
    ones), then start.

    Positions are code points, end exclusive. Null and empty texts have no spans; very long texts and texts of very many
    spans take time in proportion; repeated rows each get theirs; an empty table stays empty; other columns pass through,
    whatever their names (only one named like ``spans`` is replaced).
    """
    kind = lambda c, name: F.transform(c, lambda x: F.struct(F.lit(name).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def told(m: Column) -> Column:
        own = [kind(F.filter(m[k.name], models[k.name].accepts(k)), k.name) for k in ADDED if k.name in models]
        return F.concat(*[kind(m[k], k) for k in KINDS], *own)

    return docs.withColumn(spans, _let(_found(F.coalesce("text", F.lit(""))), told))


#: Code points of a piece of a text, when it is put together anew.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        inside = F.substring(piece(first), a - first * PIECE + 1, b - a)
        across = F.concat(F.substring(piece(first), a - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), b - last * PIECE))
        return F.when(b <= a, "").when(first == last, inside).otherwise(across)

    def put(pieces: Column, ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda x: x["end"]), F.lit(0), lambda p, q: F.greatest(p, q))
        out = F.zip_with(ordered, ends, lambda x, e: F.when(x["start"] < e, "").otherwise(F.concat(between(pieces, e, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.concat(F.array_join(out, ""), between(pieces, F.array_max(F.transform(ordered, lambda x: x["end"])), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(pieces, lambda p: _let(ordered, lambda o: put(p, o)))).otherwise(text)


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs, fit(docs)).drop("text")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
