"""Secret scans: base rules, and Markov models of random strings and ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.session import settle

# Fixed patterns: kind, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A maximal run of 24 or more is what is left of all runs once the shorter ones are dropped.
FASTER = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
#: The models judge every run of these symbols outside the base spans; a run of one has no transition.
RUN = "[A-Za-z0-9+/_=-]"
#: Runs that may well be random though no rule has judged them: they are no ordinary ones at first.
DOUBTFUL = r"(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]).{16,}+"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(SYMBOLS) + 1
#: Log-likelihood ratio in nats from which a string is taken for a random one.
THRESHOLD = 10.0
#: Weight, in transitions, of the symbols' own frequencies.
BACKOFF = 20.0
SPAN = "struct<start: int, rank: int, end: int, kind: string>"


def matches(text: Column, pattern: str, group: int, kind: str, rank: int, wanted) -> Column:
    """The spans of the leftmost non-overlapping matches, in code points, whose value ``wanted`` holds for.

    What lies between the matches and the matches themselves take turns in the text, so their lengths add
    up to the places.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    between = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["gap"])
        end = start + F.length(turn["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        kept = F.when(wanted(turn["value"]), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

    turns = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    named = F.transform(turns, lambda t: F.struct(t["gap"].alias("gap"), t["hit"].alias("hit"), t["value"].alias("value")))
    found = F.aggregate(named, state, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds base: all spans of the rules by start, then kind."""
    spans = [
        matches(F.col(text), FASTER.get(kind, pattern), group, kind, i, lambda value, least=least: F.length(value) >= least)
        for i, (kind, pattern, group, least) in enumerate(RULES)
    ]
    return docs.withColumn("base", F.array_sort(F.concat(*spans)))


def masked(text: str, spans: str, mask: Column | None = None) -> Column:
    """The text with ``mask`` for each span, or as many spaces as it has characters; spans that overlap are one."""
    body = F.col(text)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, span["start"] - acc["at"])
        put = mask if mask is not None else F.repeat(F.lit(" "), span["end"] - span["start"])
        more = F.lit("") if mask is not None else F.repeat(F.lit(" "), span["end"] - acc["at"])
        apart = span["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], gap, put)).otherwise(F.concat(acc["out"], more))
        return F.struct(out.alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, rest)).otherwise(body)


def runs(bare: Column, least: int = 2) -> Column:
    """The distinct runs of ``least`` or more symbols in a text without its base spans."""
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(f"{RUN}{{{least},}}+"), F.lit(0)))


def labelled_samples(found: DataFrame) -> DataFrame:
    """token, label and sure from texts with their base spans: label 1 for what the rules hold for secrets, 0 for other runs.

    Every text gives its samples; each distinct token counts once, and one that is both is a secret. Copies are
    counted together in each task, and the tokens are stored once. ``sure`` tokens are secrets, and runs that are not
    DOUBTFUL and stand in two rows or more: a random string seldom comes again.
    """
    inside = F.transform("base", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    secret = lambda s: F.struct(F.regexp_extract(s, r"([A-Za-z0-9+/_.=-]+)$", 1).alias("token"), F.lit(1).alias("label"))
    other = lambda t: F.struct(t.alias("token"), F.lit(0).alias("label"))
    bare = found.withColumn("bare", masked("text", "base"))
    tokens = F.concat(F.transform(inside, secret), F.transform(runs(F.col("bare")), other))
    counted = bare.select(F.inline(tokens)).groupBy("token").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n_rows"))
    sure = (F.col("label") == 1) | ((F.col("n_rows") > 1) & ~F.col("token").rlike(f"^{DOUBTFUL}$"))
    return settle(counted.select("token", "label", sure.alias("sure")))


def code(symbol: Column) -> Column:
    """1 for the first known symbol and so on, 0 for any other."""
    return F.instr(F.lit(SYMBOLS), symbol)


def train(samples: DataFrame) -> list[float] | None:
    """Log ratios of transition probabilities, random over ordinary, at [previous * SIZE + next].

    ``samples`` has token and label (1 random, 0 ordinary). Transitions of all samples are counted. None
    without samples of both kinds.
    """
    pairs = F.transform(
        F.sequence(F.lit(1), F.length("token") - 1),
        lambda i: code(F.substring(F.col("token"), i, F.lit(1))) * SIZE + code(F.substring(F.col("token"), i + 1, F.lit(1))),
    )
    counted = samples.where(F.length("token") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    rows = counted.collect()  # at most 2 * SIZE * SIZE
    if {r["label"] for r in rows} != {0, 1}:
        return None
    counts = [[0] * (SIZE * SIZE), [0] * (SIZE * SIZE)]
    for r in rows:
        counts[r["label"]][r["pair"]] = r["count"]
    ordinary, random = map(_transitions, counts)
    return [log(a / b) for a, b in zip(random, ordinary, strict=True)]


def _transitions(counts: list[int]) -> list[float]:
    """Transition probabilities; where few were seen they lean on how common the next symbol is."""
    common = [1.0 + sum(counts[i::SIZE]) for i in range(SIZE)]
    whole = sum(common)
    out = []
    for previous in range(SIZE):
        row = counts[previous * SIZE : (previous + 1) * SIZE]
        total = sum(row) + BACKOFF
        out += [(n + BACKOFF * c / whole) / total for n, c in zip(row, common, strict=True)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, random over ordinary."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    each = F.transform(
        F.sequence(F.lit(1), F.length(token) - 1),
        lambda i: F.element_at(table, code(F.substring(token, i, F.lit(1))) * SIZE + code(F.substring(token, i + 1, F.lit(1))) + 1),
    )
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def least_length(model: list[float], threshold: float) -> int:
    """Shorter runs cannot reach the threshold: no transition adds more than the largest of the model."""
    most = max(model)
    return max(2, 1 + ceil(threshold / most)) if threshold > 0 and most > 0 else 2


def scan(docs: DataFrame, text: str = "text", model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base and spans (all spans: base ones, and ``markov`` ones for random runs outside them).

    The models judge every maximal run of identifier symbols that is left once base spans are cut out, whatever
    its length or classes, each distinct run of a text once. ``text`` must not be null. Spans are [start, end)
    in code points. Without a model spans are the base ones.
    """
    based = with_base(docs, text)
    if model is None:
        return based.withColumn("spans", F.col("base"))
    least = least_length(model, threshold)
    bare = based.withColumn("bare", masked(text, "base"))
    judged = bare.withColumn("random", F.filter(runs(F.col("bare"), least), lambda t: ratio(t, model) >= threshold))
    placed = matches(F.col("bare"), f"{RUN}{{{least},}}+", 0, "markov", len(RULES), lambda run: F.array_contains("random", run))
    extra = F.when(F.size("random") > 0, placed).otherwise(F.array().cast(f"array<{SPAN}>"))
    return judged.withColumn("spans", F.array_sort(F.concat("base", extra))).drop("bare", "random")


def written(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def fitted(docs: DataFrame, text: str = "text") -> list[float] | None:
    """A model trained on all of ``docs``.

    A first model learns from the sure samples; the other runs are ordinary ones if it takes them for that, and
    the model learns from those, too. Where no run is sure, all that are not DOUBTFUL are ordinary.
    """
    body = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    samples = labelled_samples(with_base(body, "text"))
    first = train(samples.where("sure"))
    if first is None:
        return train(samples.where((F.col("label") == 1) | ~F.col("token").rlike(f"^{DOUBTFUL}$")))
    return train(samples.where(F.col("sure") | (ratio(F.col("token"), first) < 0)))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row; null texts are empty.

    Rows are judged one by one, so repeated rows and doc_ids and null doc_ids are carried as they are.
    """
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = scan(body, "text", fitted(docs, text))
    counts = [count_of(kind).alias(f"n_{kind}") for kind, *_ in RULES]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; spans that overlap are one. Null stays null."""
    model = fitted(docs, text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    clean = F.when(F.size("spans") > 0, masked("text", "spans", F.lit(mask))).otherwise(F.col(f"row.{text}"))
    found = scan(rows, "text", model).withColumn("clean", clean)
    return found.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns])
