"""Mixing sources to target weights by soft membership, in built-in functions only.

A document belongs to each domain with a posterior probability. A labelled table teaches a naive
Bayes classifier over the different words of a text and a few tokens for its shape (share of symbols,
length of words, repetition, length); from the posteriors p and the documents' token counts t,
nonnegative rates w are fitted so that the expected domain totals sum(w t p) meet their targets:

    minimise  sum_k (E_k(w) - g_k)^2 / (2 g_k)  +  ridge / 2 * sum_d a_d (w_d - 1)^2,   w >= 0

with a = t / sum(t) and E, g as shares of all tokens. It is solved by projected gradient steps in the
metric a, so a step is w <- max(0, v - s (sum_k r_k p_k / g_k + ridge (v - 1))), r = E(v) - g, taken at
a point v a little beyond w (constant momentum). Posteriors
are rounded to 1 / GRID; documents with equal posteriors have equal rates, so steps run over at
most GRID**(domains - 1) pre-aggregated cells, and a document's rate is refolded from the steps.

Targets are weights by domain. Their scale is such that `anchor` needs the rate 1: the other domains are
measured against what the anchor has. Where rates above `most` cannot be applied, steps are projected to
[0, most], so that the totals that are met are those of the rates as applied.

Training: at most about `sample` labelled rows (a documented bound), whose ids are broadcast. All tokens that pass
the tests of lift and merit count; their table is broadcast where its measured size is under `MOST_TOKENS`.
Steps go on until no domain's total moves by more than `SETTLED` of its goal; not settling is an error.

Defined cases: null or empty texts have 0 tokens and the posterior that their shape tokens give; with
no labelled rows all domains are equally likely; without tokens at all rates stay 1. Repeated rows are
rows of their own with equal results; an empty table gives an empty result. Long texts are read whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, hash_fraction, let

SAMPLE, GRID, STEPS, RIDGE, SETTLED = 4000, 200, 400, 0.02, 1e-5
CELL_TASKS = 8  # of a gradient step, as cells are at most about GRID**2 / 2 whatever the data's size
MOST_TOKENS = 1 << 20  # of a token table that is broadcast; a larger one is joined by token
LEAST_MERIT, LEAST_LIFT = 5.0, 5.0
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}


def label_domain(quality: Column, toxic: Column) -> Column:
    """The domain that a row of `labels` gives."""
    return F.when(quality == 0, "low").when(toxic == 1, "toxic").when(quality == 1, "clean")


def _shape(lower: Column, words: Column, distinct: Column) -> Column:
    """Tokens such as `#symbols:3` that no word can be, as # is no word character."""
    n = F.greatest(F.size(words), F.lit(1))
    size = F.greatest(F.length(lower), F.lit(1))
    level = lambda name, x: F.concat(F.lit(f"#{name}:"), F.least(x, F.lit(40)).cast("int").cast("string"))
    return F.array(
        # A few words of usual shape are added, so that short texts do not look odd by chance.
        level("symbols", F.floor(40 * (size - F.length(F.array_join(words, " "))) / (size + 60))),
        level("gap", F.floor((size + 60) / (n + 10))),
        level("repeat", F.floor(10 * (F.size(distinct) + 8) / (n + 10))),
        level("length", F.floor(F.log2(n))),
    )


def _tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, t, different): number of words, and different tokens, of every row."""
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    words = F.array_remove(F.split(F.regexp_replace("lower", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), "")
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), lower.alias("lower"))
    own = own.withColumn("words", words).withColumn("distinct", F.array_distinct("words"))
    return own.select("key", "row", F.size("words").cast("long").alias("t"), F.concat("distinct", _shape(F.col("lower"), F.col("words"), F.col("distinct"))).alias("different"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, list[float]] | None:
    """Token table (token, lw array<double>) and the log priors, from `labels` (key, domain).

    A chosen word that is missing counts too, so a word's lw is log p - log(1 - p) and the prior holds the
    sum of log(1 - p). Common words are not chosen, as their absence mostly tells that a text is short.
    Of a shape's tokens just one is present, so its lw is log p.
    """
    given = labels.where(F.col("domain").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "domain")
    counts = {r[0]: r[1] for r in given.groupBy("domain").count().collect()}
    if not counts:
        return None
    each = sample / len(counts)
    share = F.create_map(*[F.lit(v) for d, n in counts.items() for v in (d, min(1.0, each / n))])
    picked = given.where(hash_fraction(F.col("key"), 707) < share[F.col("domain")])
    rows = _tokenised(docs.join(F.broadcast(picked.select(F.col("key").alias(key))), key, "left_semi"), key, text).join(F.broadcast(picked), "key")
    # Copies of one text teach once a domain, else each of their words would seem to tell the domain.
    held = durable(rows.groupBy("domain", "row").agg(F.first("different").alias("different")))
    n = {r[0]: r[1] for r in held.groupBy("domain").count().collect()}
    if not n:
        return None
    per = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{i}") for i, d in enumerate(DOMAINS)]
    count = held.select("domain", F.explode("different").alias("token")).groupBy("token").agg(*per)
    chance = [(F.col(f"c{i}") + 0.5) / (n.get(d, 0) + 1.0) for i, d in enumerate(DOMAINS)]
    seen, total = sum(F.col(f"c{i}") for i in range(len(DOMAINS))), sum(n.values())
    # A token counts if its share in a domain is LEAST_LIFT times that elsewhere, or the reverse, and differs by
    # LEAST_MERIT standard errors. How common it is does not matter: domains may have many rare words.
    differs = []
    for i, d in enumerate(DOMAINS):
        c, m = F.col(f"c{i}"), n.get(d, 0)
        a, b, both = c / max(1, m), (seen - c) / max(1, total - m), seen / total
        far = F.abs(F.log(chance[i]) - F.log((seen - c + 0.5) / (total - m + 1.0))) >= math.log(LEAST_LIFT)
        differs.append(F.when(far, 1.0).otherwise(0.0) * F.abs(a - b) / F.sqrt(both * (1 - both) * (1 / max(1, m) + 1 / max(1, total - m)) + 1e-9))
    top = count.where(seen >= 3).withColumn("merit", F.greatest(*differs)).where(F.col("merit") >= LEAST_MERIT)
    missing = [F.when(F.startswith("token", F.lit("#")), 0.0).otherwise(F.log(1 - c)) for c in chance]
    table = durable(top.select("token", F.array(*[F.log(c) - m for c, m in zip(chance, missing)]).alias("lw"), F.array(*missing).alias("lm")))
    absent = table.select(*[F.coalesce(F.sum(F.col("lm")[i]), F.lit(0.0)) for i in range(len(DOMAINS))]).first()
    rows_all = sum(counts.values())
    prior = [math.log((counts.get(d, 0) + 0.5) / (rows_all + 0.5 * len(DOMAINS))) + absent[i] for i, d in enumerate(DOMAINS)]
    table = table.select("token", "lw")
    return table, prior


def posteriors(docs: DataFrame, model: tuple[DataFrame, list[float]] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, copies, t, p array of whole numbers of 1 / GRID) by key and text hash."""
    k = len(DOMAINS)
    table, prior = model if model is not None else (docs.sparkSession.createDataFrame([], "token string, lw array<double>"), [0.0] * k)
    rows = _tokenised(docs, key, text)
    # The first token of each row is a header that carries the number of words, and counts the copies of a row.
    each = rows.select("key", "row", F.posexplode(F.concat(F.array(F.lit("")), "different")).alias("at", "token"), "t")
    hits = each.join(F.broadcast(table) if table.count() <= MOST_TOKENS else table, "token", "left").where((F.col("at") == 0) | F.col("lw").isNotNull())
    header = F.when(F.col("at") == 0, F.lit(1))
    found = hits.groupBy("key", "row").agg(F.count(header).alias("copies"), F.max("t").alias("t"), *[F.coalesce(F.sum(F.when(F.col("at") > 0, F.col("lw")[i])), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    raw = [F.col(f"s{i}") / F.col("copies") + prior[i] for i in range(k)]
    most = F.greatest(*raw)
    e = [F.exp(F.greatest(x - most, F.lit(-60.0))) for x in raw]
    total = sum(e[1:], e[0])
    return found.select("key", "row", "copies", "t", F.array(*[F.round(x / total * GRID).cast("int") for x in e]).alias("p"))


def fit_rates(cells: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = "clean", most: float = math.inf, steps: int = STEPS, ridge: float = RIDGE) -> list[dict]:
    """Steps of the projected gradient over (p, t) cells: w <- min(most, max(0, keep * v + add - sum_k pull_k p_k)), v <- w + ahead * (w - before)."""
    k = len(DOMAINS)
    sums = [F.sum(F.col("t") * F.col("p")[i] / GRID) for i in range(k)]
    both = [F.sum(F.col("t") * F.col("p")[i] / GRID * F.col("p")[j] / GRID) for i in range(k) for j in range(k)]
    got = cells.agg(F.sum("t"), *sums, *both).first()
    total = float(got[0] or 0)
    if not total:
        return []
    have = [float(x) / total for x in got[1 : k + 1]]
    unit = have[DOMAINS.index(anchor)] / targets[anchor]
    goal = [max(targets[d] * unit, 1e-6) for d in DOMAINS]
    gram = [[float(got[1 + k + i * k + j]) / total / (goal[i] * goal[j]) ** 0.5 for j in range(k)] for i in range(k)]
    bound = max(sum(abs(x) for x in row) for row in gram) + ridge
    size = 1.0 / bound
    root = (size * ridge) ** 0.5
    ahead = (1 - root) / (1 + root)  # momentum for a loss that curves between ridge and bound
    done: list[dict] = []
    held = durable(cells.coalesce(CELL_TASKS))
    seen, at = have, have
    for step in range(steps):
        pull = [size * (e - g) / g / GRID for e, g in zip(at, goal)]
        done.append({"keep": 1 - size * ridge, "add": size * ridge, "pull": pull, "ahead": ahead})
        # The steps so far are one array literal, so that every step runs the same compiled code.
        now = held.select("p", "t", refolded(done, most).alias("s"))
        row = now.agg(*[F.sum(F.col(f"s.{c}") * F.col("t") * F.col("p")[i] / GRID) for c in "wv" for i in range(k)]).first()
        new, at = [float(x) / total for x in row[:k]], [float(x) / total for x in row[k:]]
        moved = max(abs(a - b) / g for a, b, g in zip(new, seen, goal))
        if moved < SETTLED and step:
            return done
        seen = new
    raise RuntimeError(f"rates have not settled after {steps} steps: the last moved a total by {moved:.2g} of its goal")


def refolded(steps: list[dict], most: float) -> Column:
    """struct(w, v) of a row with posteriors p after all steps."""
    names = [*("keep", "add", "ahead"), *(f"g{i}" for i in range(len(DOMAINS)))]
    rows = [dict(zip(names, [s["keep"], s["add"], s["ahead"], *s["pull"]])) for s in steps]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<" + ", ".join(f"{n}: double" for n in names) + ">>")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("v"))
    return F.aggregate(listed, start, lambda w, s: _stepped(w, s["keep"], s["add"], s["ahead"], [s[f"g{i}"] for i in range(len(DOMAINS))], most))


def _stepped(s: Column, keep: object, add: object, ahead: object, pull: list[Column], most: float) -> Column:
    """The state after a step: the rate w, and the point v beyond it where the next gradient is taken."""
    down = pull[0] * F.col("p")[0]
    for i, x in enumerate(pull[1:], 1):
        down = down + x * F.col("p")[i]

    def after(w: Column) -> Column:
        return F.struct(w.alias("w"), (w + ahead * (w - s["w"])).alias("v"))

    w = F.greatest(F.lit(0.0), s["v"] * keep + add - down)
    return let(w if math.isinf(most) else F.least(F.lit(float(most)), w), after)


def mix(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, anchor: str = "clean", most: float = math.inf) -> DataFrame:
    """(key, row, copies, n_tokens, domain, p_<domain>..., rate) by key and text hash; `labels` is (key, domain)."""
    found = durable(posteriors(docs, train(docs, labels, key, text), key, text))
    cells = found.groupBy("p").agg(F.sum(F.col("t") * F.col("copies")).alias("t"))
    steps = fit_rates(cells, targets, anchor, most)
    rate = refolded(steps, most)["w"] if steps else F.lit(1.0)
    best = F.array_position("p", F.array_max("p")).cast("int")
    shares = [(F.col("p")[i] / GRID).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return found.select("key", "row", "copies", F.col("t").alias("n_tokens"), F.element_at(F.array(*map(F.lit, DOMAINS)), best).alias("domain"), *shares, rate.alias("rate"))


def mix_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS) -> DataFrame:
    """(key, n_tokens, domain, p_<domain>..., rate), one row for each row of `docs`."""
    mixed = mix(docs, labels, key, text, targets)
    out = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("key").alias(key), "n_tokens", "domain", *[f"p_{d}" for d in DOMAINS], "rate")
