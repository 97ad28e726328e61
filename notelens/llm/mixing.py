"""Operator 8: mixing documents to target weights of domains by soft membership.

A classifier learned from a table of labelled texts gives every document a posterior
over the domains, and the tokens of a document count for the domains by it. Rates
r >= ``least`` (0: a document may go) are fitted by least squares so that the expected
tokens of every domain, sum of r * tokens * posterior, meet its target. Copies are the
rates rounded at random, without bias, by a hash of the document's id and text.

* Classifier: naive Bayes over marker words. Markers are the words whose counts speak
  most for a domain; they and their shares come from about ``SAMPLE`` labelled rows,
  chosen by a hash of id and text: all rows of domains with few, equally many of the
  others, at least one of each; markers are found with counts scaled up to all rows.
  Evidence is scaled to at most ``EVIDENCE`` words, so documents of mixed text keep soft
  posteriors. How often a marker must occur follows the domain's own sampled tokens, ``LEAST_SUPPORT`` times at most, so
  that a domain of a few rows has its markers, too.
* Fit: projected gradient in the metric of tokens. With residuals divided by the
  domains' own tokens, a step of 1 cannot overshoot: for a posterior p, p p' <= diag(p),
  so the curvature is at most 1. A round is one aggregate of as many sums as domains
  over the staged (tokens, posterior) table; rates follow from the rounds' few numbers
  and are never stored until the end. All documents count in every round.

Only DataFrame functions are used. Nulls and texts without words have no tokens, the
prior as posterior, and get a rate like any other. Rows without a label are not
learned from; without any labelled row there are no domains, and every rate is
max(1, least). A weight above 0 for a domain without labelled rows is refused, and so are
given weights that no rates meet (``UNMET``); of the default weights a warning tells the
same. Domains are few (``max_domains``; more are refused). Rows with the same id and the
same text get equal rates and copies, all others are rounded on their own. Outputs replace
columns of the same name.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.llm.tables import staged

#: Labelled rows that the classifier is learned from, about.
SAMPLE = 4000
MAX_DOMAINS, MARKERS, LEAST_SUPPORT = 64, 6, 20
#: Values of the hash that rows are sampled by.
CELLS = 1 << 40
EVIDENCE = 30.0
#: Rounds of the fit at most; it stops when no domain is further than TOLERANCE of all tokens from its target, or moves
#: less than STALLED of them (targets that no rates can meet).
ROUNDS, TOLERANCE, STALLED = 40, 1e-5, 1e-4
#: A domain further than this share of all tokens from its target counts as not met.
UNMET = 0.01
#: Sampled tokens of a domain for each occurrence that its markers need.
PER_SUPPORT = 500
OUTPUTS = ("tokens", "posterior", "rate", "copies")

WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Classifier:
    domains: list[str]
    markers: list[str]
    log_prior: list[float]
    #: log shares of the markers, then of all other words, by domain
    log_share: list[list[float]]


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def _occurrences(text: Column, word: str) -> Column:
    """How often a word stands between spaces; of two that share a space, the second does not count."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    found = F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(f" {word} "), F.lit("")))
    return found / float(len(word.encode()) + 2)


def _shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each domain's rows to read: all of the small ones, equally many of each other, ``sample`` together."""
    left, quota = float(sample), math.inf
    for k, n in enumerate(sorted(counts.values())):
        quota = left / (len(counts) - k)
        if n > quota:
            break
        left, quota = left - n, math.inf
    return {d: min(1.0, quota / n) for d, n in counts.items()}


def learn(labelled: DataFrame, domain: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE,
          max_domains: int = MAX_DOMAINS) -> Classifier:
    """Learn from a table of labelled texts."""
    known = labelled.filter(F.col(domain).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(domain).cast("string").alias("domain"), F.col(text).alias("text"))
    cell = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(CELLS))
    listed = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min(cell).alias("first")).limit(max_domains + 1).collect()
    counts = {r["domain"]: r["n"] for r in listed}
    if len(counts) > max_domains:
        raise ValueError(f"more than {max_domains} domains")
    domains, total = sorted(counts), sum(counts.values())
    if not domains:
        return Classifier([], [], [], [])
    share, first = _shares(counts, sample), {r["domain"]: r["first"] for r in listed}
    bound = F.lit(0)
    for d in domains:
        bound = F.when(F.col("domain") == d, F.lit(max(math.ceil(share[d] * CELLS), first[d] + 1))).otherwise(bound)
    rows = known.filter(cell < bound)
    words = (rows.select("domain", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
             .filter(F.length("word") > 1).groupBy("word", "domain").count())
    words = staged(words, "domain-words")
    sampled = {r["domain"]: r["n"] for r in words.groupBy("domain").agg(F.sum("count").alias("n")).collect()}  # a row a domain
    often = F.lit(False)
    for k, d in enumerate(domains):
        needed = min(LEAST_SUPPORT, sampled.get(d, 0) // PER_SUPPORT + 1)
        # counts are scaled up to all rows
        often = often | (F.col(f"n{k}") * F.lit(share[d]) > F.lit(needed - 0.5))
    wide = staged(words.groupBy("word").agg(
        *[F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0) / F.lit(share[d])).alias(f"n{k}") for k, d in enumerate(domains)])
        .filter(often)
        .withColumn("n", sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0.0))), "marker-words")
    sums = wide.agg(F.sum("n"), *[F.sum(f"n{k}") for k in range(len(domains))]).first()
    markers: list[str] = []
    for k in range(len(domains) if sums[0] else 0):
        own, rest = F.col(f"n{k}"), F.col("n") - F.col(f"n{k}")
        own_sum, rest_sum = (sums[k + 1] or 0) + 1.0, sums[0] - (sums[k + 1] or 0) + 1.0
        gain = own * F.log(((own + 0.5) / own_sum) / ((rest + 0.5) / rest_sum))
        markers += [r["word"] for r in wide.orderBy(gain.desc(), "word").limit(MARKERS).collect()]
    markers = sorted(set(markers))
    stats = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(_tokens(F.col("text"))).alias("tokens"),
        *[F.sum(_occurrences(F.col("text"), w)).alias(f"m{k}") for k, w in enumerate(markers)]).collect()
    found = {r["domain"]: r for r in stats}
    log_prior, log_share = [], []
    for d in domains:
        r = found[d]
        log_prior.append(math.log(counts[d] / total))
        own = [r[f"m{k}"] for k in range(len(markers))]
        other = max(0.0, r["tokens"] - sum(own))
        whole = sum(own) + other + len(markers) + 1
        log_share.append([math.log((c + 1) / whole) for c in [*own, other]])
    return Classifier(domains, markers, log_prior, log_share)


def membership(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and ``posterior``, an array by domain."""
    wide = docs.drop("tokens", "posterior")
    names = wide.columns
    body = F.col(text)
    if not model.domains:
        return wide.select(*names, _tokens(body).cast("bigint").alias("tokens"), F.array().cast("array<double>").alias("posterior"))
    # plain columns: what is read from an array in place would be worked out anew for each reading
    count = [f"_count{k}" for k in range(len(model.markers))]
    counted = wide.select(*names, _tokens(body).cast("bigint").alias("tokens"),
                          *[_occurrences(body, w).alias(c) for w, c in zip(model.markers, count)])
    other = F.greatest(F.lit(0.0), F.col("tokens") - sum((F.col(c) for c in count), F.lit(0.0)))
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.lit(1.0), F.col("tokens").cast("double")))
    counted = counted.select(*names, "tokens", *count, other.alias("_other"), scale.alias("_scale"))
    logs = [f"_log{k}" for k in range(len(model.domains))]
    scored = counted.select(*names, "tokens", *[
        (F.lit(prior) + F.col("_scale") * sum((F.col(c) * F.lit(s) for c, s in zip([*count, "_other"], share)), F.lit(0.0))).alias(name)
        for name, prior, share in zip(logs, model.log_prior, model.log_share)])
    top = F.greatest(*logs) if len(logs) > 1 else F.col(logs[0])
    massed = scored.select(*names, "tokens", *logs, top.alias("_top"))
    massed = massed.select(*names, "tokens", *[F.exp(F.col(c) - F.col("_top")).alias(c) for c in logs])
    summed = massed.select(*names, "tokens", *logs, sum((F.col(c) for c in logs), F.lit(0.0)).alias("_sum"))
    return summed.select(*names, "tokens", F.array(*[F.col(c) / F.col("_sum") for c in logs]).alias("posterior"))


@dataclass
class Fit:
    """What gives a document its rate: a vector of the domains for each round."""

    steps: list[list[float]]
    least: float
    targets: list[float]
    reached: list[float]

    def unmet(self) -> list[int]:
        """Domains whose expected tokens are far from their target."""
        total = sum(self.targets)
        return [k for k, (r, t) in enumerate(zip(self.reached, self.targets)) if abs(r - t) > UNMET * total]

    def rate(self, posterior: str = "posterior") -> Column:
        rate = F.lit(max(1.0, self.least))
        for step in self.steps:
            moves = [F.get(posterior, F.lit(k)) * F.lit(s) for k, s in enumerate(step)]
            rate = F.greatest(F.lit(self.least), rate - sum(moves[1:], moves[0]))
        return rate


def smoothed(tokens: list[float], power: float) -> list[float]:
    """Weights between the domains' own shares (power 1) and equal ones (power 0)."""
    raised = [t ** power if t > 0 else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised] if sum(raised) else raised


def fit(members: DataFrame, n_domains: int, weights: list[float] | None = None, power: float = 0.7, least: float = 0.0,
        keep_all: bool = False) -> Fit:
    """Fit rates over a staged table with ``tokens`` and ``posterior``.

    ``weights`` are the target shares by domain (none: ``smoothed`` ones). The target total is the tokens there are or,
    with ``keep_all``, the smallest total for which no domain shrinks.
    """
    if not n_domains:
        return Fit([], least, [], [])
    each = [F.col("tokens") * F.get("posterior", F.lit(k)) for k in range(n_domains)]

    def totals(rate: Column) -> list[float]:
        row = members.agg(*[F.sum(rate * e) for e in each]).first()
        return [float(v or 0.0) for v in row]

    own = totals(F.lit(1.0))
    if weights is None:
        weights = smoothed(own, power)
    if len(weights) != n_domains or min(weights) < 0:
        raise ValueError("one weight of 0 or more is needed for each domain")
    whole = sum(weights) or 1.0
    weights = [w / whole for w in weights]
    total = sum(own)
    if keep_all:
        total = max([total, *[o / w for o, w in zip(own, weights) if w > 0]])
    targets = [w * total for w in weights]
    result = Fit([], least, targets, own)
    for _ in range(ROUNDS):
        before, result.reached = result.reached, totals(result.rate()) if result.steps or least > 1 else own
        gap = [r - t for r, t in zip(result.reached, targets)]
        stalled = result.steps and all(abs(r - b) <= STALLED * total for r, b in zip(result.reached, before))
        if stalled or all(abs(g) <= TOLERANCE * total for g in gap):
            break
        result.steps.append([g / o if o > 0 else 0.0 for g, o in zip(gap, own)])
    else:
        result.reached = totals(result.rate())
    return result


def _listed(weights: dict[str, float] | None, model: Classifier) -> list[float] | None:
    """The weights in the order of the domains (0 where none is named)."""
    if weights is None:
        return None
    missing = sorted(d for d, w in weights.items() if w and d not in model.domains)
    if missing:
        raise ValueError(f"no labelled row of domains with a weight: {missing}")
    return [float(weights.get(d, 0.0)) for d in model.domains]


def _told(found: Fit, model: Classifier, given: bool) -> None:
    """Refuse given weights that the fit did not meet; warn of default ones."""
    missed = [f"{model.domains[k]}: {found.reached[k]:.0f} tokens for {found.targets[k]:.0f}" for k in found.unmet()]
    if missed and given:
        raise ValueError(f"weights not met: {missed}")
    if missed:
        warnings.warn(f"default weights not met: {missed}", stacklevel=3)


def copies(rate: Column, *keys: Column) -> Column:
    """Whole copies whose expected number is the rate, by a hash of the keys."""
    u = (F.xxhash64(*keys, F.lit(23)) / F.lit(2.0 ** 64)) + 0.5
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, power: float = 0.7,
        least: float = 0.0, keep_all: bool = False) -> DataFrame:
    """``doc_id``, ``tokens``, ``posterior``, ``rate`` and ``copies`` of every row of ``docs``."""
    model = learn(labelled, domain)
    listed = _listed(weights, model)
    members = staged(membership(docs.select("doc_id", "text"), model).select(
        "doc_id", "tokens", "posterior", F.xxhash64("text").alias("_text_key")), "membership")
    found = fit(members, len(model.domains), listed, power, least, keep_all)
    _told(found, model, weights is not None)
    rated = members.withColumn("rate", found.rate())
    return rated.withColumn("copies", copies(F.col("rate"), F.coalesce("doc_id", F.lit(-1)), F.col("_text_key"))).drop("_text_key")


def remix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, power: float = 0.7,
          least: float = 0.0, keep_all: bool = False) -> DataFrame:
    """``docs`` with every row as often as its copies say, in the columns of ``docs``.

    The rows are staged with their posterior, so that no text is read twice or shuffled.
    """
    model, names = learn(labelled, domain), docs.columns
    listed = _listed(weights, model)
    row = F.struct(*[F.col(n) for n in names])
    members = staged(membership(docs.select(row.alias("_row"), F.col("text").alias("_text")), model, "_text")
                     .select("_row", "tokens", "posterior"), "membership")
    found = fit(members, len(model.domains), listed, power, least, keep_all)
    _told(found, model, weights is not None)
    rated = members.select("_row", found.rate().alias("_rate"))
    number = copies(F.col("_rate"), F.coalesce(F.col("_row.doc_id"), F.lit(-1)), F.xxhash64(F.col("_row.text")))
    return (rated.select("_row", F.explode(F.array_repeat(F.lit(0), number)).alias("_copy"))
            .select(*[F.col("_row").getField(n).alias(n) for n in names]))
