"""Models and external tools behind small interfaces; what ships here needs neither weights nor network."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsidora import schemas
from capsidora.functions import sequences

#: From a batch of sequences to one value each.
Model = Callable[[Sequence[str]], Sequence]


def predict(df: DataFrame, sequence: str, load: Callable[[], Model], out: str, kind: str) -> DataFrame:
    """``df`` with a model's output for each sequence; the model is loaded once per Python worker and gets whole Arrow batches."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())), index=s.index)

    return df.withColumn(out, run(F.col(sequence)))


def flat_structure() -> Model:
    """Stands in for a structure predictor: the state D for each residue."""
    return lambda texts: ["D" * len(t) for t in texts]


def onnx_structure(path: str, tokens: dict[str, int], states: dict[int, str], start: int, end: int, pad: int = 0, batch: int = 8) -> Callable[[], Model]:
    """A structure predictor from an ONNX file (input_ids, attention_mask to logits), as a loader for :func:`predict`; texts become structural states.

    Sequences are batched by length; unknown letters take the token of X. The file's path must be known to every executor.
    """

    def load() -> Model:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])

        def run(texts: Sequence[str]) -> list[str]:
            out = [""] * len(texts)
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                width = max(len(texts[i]) for i in own) + 2
                ids, mask = np.full((len(own), width), pad, np.int64), np.zeros((len(own), width), np.int64)
                for r, i in enumerate(own):
                    row = [start, *(tokens.get(c, tokens["X"]) for c in texts[i].upper()), end]
                    ids[r, : len(row)], mask[r, : len(row)] = row, 1
                logits = session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
                for r, i in enumerate(own):
                    out[i] = "".join(states.get(int(x), "D") for x in logits[r, 1 : len(texts[i]) + 1].argmax(1))
            return out

        return run

    return load


def confidences(logits: np.ndarray, length: int) -> list[float]:
    """Per residue the greatest softmax probability of a decoder's logits (steps x states), cut to ``length`` or filled up with their mean; 1 without any."""
    if not len(logits):
        return [1.0] * length
    x = logits - logits.max(1, keepdims=True)
    p = (np.exp(x) / np.exp(x).sum(1, keepdims=True)).max(1).tolist()
    return p[:length] if len(p) >= length else p + [float(np.mean(p))] * (length - len(p))


def composition() -> Model:
    """Stands in for an encoder: the unit vector of the 26 letters' counts."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.bincount([ord(c) - 65 for c in t.upper() if "A" <= c <= "Z"] or [0], minlength=26).astype(float)
            out.append((v / np.sqrt((v * v).sum())).tolist())
        return out

    return run


# The lower triangle of the BLOSUM62 matrix, in the order of its letters.
_LETTERS = "ARNDCQEGHILKMFPSTWYV"
_BLOSUM62 = """4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""


def substitutions(triangle: str = _BLOSUM62, letters: str = _LETTERS) -> np.ndarray:
    """Scores of all pairs of byte values from a lower triangle. B and Z take the mean of what they stand for, any other letter -1, a stop -4 (with itself 1)."""
    m = np.full((256, 256), -1.0)
    rows = [list(map(float, line.split())) for line in triangle.splitlines()]
    for i, row in enumerate(rows):
        for j, v in enumerate(row):
            m[ord(letters[i]), ord(letters[j])] = m[ord(letters[j]), ord(letters[i])] = v
    for letter, pair in (("B", "ND"), ("Z", "QE")):
        if set(pair) <= set(letters):
            both = np.rint((m[ord(pair[0])] + m[ord(pair[1])]) / 2)
            m[ord(letter)], m[:, ord(letter)] = both, both
            m[ord(letter), ord(letter)] = 4
    m[ord("*")], m[:, ord("*")] = -4, -4
    m[ord("*"), ord("*")] = 1
    return m


_MATRIX = substitutions()


def align(a: str, b: str, matrix: np.ndarray = _MATRIX, opening: float = -11, extending: float = -1) -> tuple[float, float]:
    """Score and identity over aligned columns of a global alignment with affine gaps; a whole anti-diagonal is filled at once."""
    if not a or not b:
        return 0.0, 0.0
    low = -1e18
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode("latin-1", "replace"), np.uint8), np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    # three states: in a match, in a gap of b, in a gap of a; kept for two diagonals, by the place in a
    before, last = np.full((3, n + 1), low), np.full((3, n + 1), low)
    last[0, 0] = 0
    back = np.zeros((n + m + 1, 3, n + 1), np.uint8)
    costs = np.array([[opening, extending, opening], [opening, opening, extending]])
    for d in range(1, n + m + 1):
        now = np.full((3, n + 1), low)
        i = np.arange(max(0, d - m), min(n, d) + 1)
        both, up, side = i[(i > 0) & (i < d)], i[i > 0], i[i < d]
        if len(both):
            came = before[:, both - 1]
            k = came.argmax(0)
            now[0, both] = came[k, np.arange(len(both))] + matrix[x[both - 1], y[d - both - 1]]
            back[d, 0, both] = k
        for state, own, rows in ((1, up, up - 1), (2, side, side)):
            if len(own):
                came = last[:, rows] + costs[state - 1][:, None]
                k = came.argmax(0)
                now[state, own] = came[k, np.arange(len(own))]
                back[d, state, own] = k
        before, last = last, now
    k = int(last[:, n].argmax())
    score, i, j, same, columns = float(last[k, n]), n, m, 0, 0
    while i or j:
        p = int(back[i + j, k, i])
        if k == 0:
            same += a[i - 1] == b[j - 1]
            columns += 1
            i, j = i - 1, j - 1
        elif k == 1:
            i -= 1
        else:
            j -= 1
        k = p
    return score, same / columns if columns else 0.0


def aligned_identity(df: DataFrame, first: str, second: str, out: str = "identity") -> DataFrame:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align(x or "", y or "")[1] for x, y in zip(a, b, strict=True)])

    return df.withColumn(out, run(F.col(first), F.col(second)))


#: The least identity that a triage match must have (a fixed value).
LEAST_IDENTITY = 0.15


def realigned(matches: DataFrame, queries: DataFrame, references: DataFrame, least: float = LEAST_IDENTITY) -> DataFrame:
    """Matches (id, target, source_db, ...) with identity and kept: a match stays if its alignment reaches ``least``, or if either sequence isn't known.

    ``queries``: id, sequence; ``references``: name, source_db, sequence.
    """
    q = queries.select("id", F.nullif("sequence", F.lit("")).alias("q__"))
    r = references.select(F.col("name").alias("target"), "source_db", F.nullif("sequence", F.lit("")).alias("r__"))
    both = matches.join(q, "id", "left").join(r, ["target", "source_db"], "left")
    known = F.col("q__").isNotNull() & F.col("r__").isNotNull()
    # only pairs of known sequences are aligned
    some = aligned_identity(both.where(known), "q__", "r__")
    rest = both.where(~known).withColumn("identity", F.lit(None).cast("double"))
    return some.unionByName(rest).withColumn("kept", F.coalesce(F.col("identity") >= least, F.lit(True))).drop("q__", "r__")


class Network:
    """A feed-forward classifier: weights and biases of each layer, a layer norm (gain, shift) and ReLU behind all but the last."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], norms: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.layers, self.norms = layers, norms or []

    def hidden(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers, logits last."""
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                if self.norms:
                    gain, shift = self.norms[i]
                    x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * gain + shift
                x = np.maximum(x, 0)
            out.append(x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(np.asarray(x, float))[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def save(self, path: str) -> None:
        arrays = {f"w{i}": w for i, (w, _) in enumerate(self.layers)} | {f"b{i}": b for i, (_, b) in enumerate(self.layers)}
        np.savez(path, **arrays, **{f"g{i}": g for i, (g, _) in enumerate(self.norms)}, **{f"h{i}": h for i, (_, h) in enumerate(self.norms)})

    @classmethod
    def load(cls, path: str) -> Network | None:
        """A network from an .npz file; none where the file is absent."""
        if not os.path.exists(path):
            return None
        z = np.load(path, allow_pickle=False)
        n = sum(k.startswith("w") for k in z.files)
        return cls([(z[f"w{i}"], z[f"b{i}"]) for i in range(n)], [(z[f"g{i}"], z[f"h{i}"]) for i in range(n - 1)] if "g0" in z.files else None)


def _macro_f1(truth: np.ndarray, told: np.ndarray, classes: int) -> float:
    tp, p, t = (np.bincount(x, minlength=classes) for x in (truth[truth == told], told, truth))
    held = t > 0
    return float(np.mean(np.where(tp > 0, 2 * tp / np.maximum(p + t, 1), 0.0)[held])) if held.any() else 0.0


def train(x: np.ndarray, y: np.ndarray, classes: int, hidden: Sequence[int] = (64,), epochs: int = 40, batch: int = 256, rate: float = 1e-2, decay: float = 0.01, held_out: float = 0.15, patience: int = 6, seed: int = 42) -> tuple[Network, float]:
    """A classifier trained by AdamW with a cosine schedule and class weights, and its best macro F1 on the held-out rows, at which it stops."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, int(len(x) * held_out))
    test, own = order[:cut], order[cut:]
    sizes = [x.shape[1], *hidden, classes]
    values = [p for a, b in zip(sizes[:-1], sizes[1:], strict=True) for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
    weight = len(own) / (classes * np.maximum(np.bincount(y[own], minlength=classes), 1))
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    net = lambda: Network(list(zip(values[::2], values[1::2], strict=True)))
    best, kept, waited = -1.0, [v.copy() for v in values], 0
    for epoch in range(epochs):
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        own = rng.permutation(own)
        for at in range(0, len(own), batch):
            rows = own[at : at + batch]
            out = net().hidden(x[rows])
            p = np.exp(out[-1] - out[-1].max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            grad = p * weight[y[rows]][:, None] / len(rows)
            step += 1
            for i in range(len(sizes) - 2, -1, -1):
                gw, gb = out[i].T @ grad, grad.sum(0)
                if i:
                    grad = (grad @ values[2 * i].T) * (out[i] > 0)
                for j, g in ((2 * i, gw), (2 * i + 1, gb)):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    values[j] = values[j] * (1 - lr * decay) - lr * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        score = _macro_f1(y[test], net().hidden(x[test])[-1].argmax(1), classes)
        if score > best:
            best, kept, waited = score, [v.copy() for v in values], 0
        elif (waited := waited + 1) >= patience:
            break
    values = kept
    return net(), best


def fit(rows: DataFrame, embedding: str, label: str, names: list[str], most: int = 50_000, **options: object) -> tuple[Network, float]:
    """A classifier of labelled rows, fitted on a sample of at most ``most`` of them (drawn by a hash of the vector); labels outside ``names`` don't count."""
    held = rows.where(F.col(label).isin(names)).select(F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("y")).where("x is not null")
    sample = held.orderBy(F.xxhash64("x"), "y").limit(most).toPandas()
    if not len(sample):
        raise ValueError("no labelled rows")
    return train(np.array(sample.x.tolist()), np.array([names.index(v) for v in sample.y]), len(names), **options)


def classify(df: DataFrame, embedding: str, network: Network | list, names: list[str], confident: float = 0.5, entropy: float = 0.6) -> DataFrame:
    """``df`` with category, confidence and accepted, by a network; accepted means confident, of low normalised entropy and not unknown."""
    network = network if isinstance(network, Network) else Network(network)

    @F.pandas_udf("category string, confidence double, accepted boolean")
    def run(e: pd.Series) -> pd.DataFrame:
        p = network.probabilities(np.array(e.tolist(), dtype=float))
        best = p.argmax(1)
        spread = -(p * np.log(np.maximum(p, 1e-12))).sum(1) / np.log(p.shape[1])
        named = np.array(names)[best]
        return pd.DataFrame({"category": named, "confidence": p.max(1), "accepted": (p.max(1) >= confident) & (spread <= entropy) & (named != "unknown")})

    return df.withColumn("c__", run(F.col(embedding))).select(*df.columns, "c__.*")


def contrastive_loss(embeddings: np.ndarray, labels: np.ndarray, temperature: float = 0.07, hardness: float = 0.0) -> float:
    """Supervised contrastive loss of a batch of unit vectors; ``hardness`` above 0 weighs other labels by their similarity. Rows without another of their label don't count."""
    sim = embeddings @ embeddings.T / temperature
    np.fill_diagonal(sim, -np.inf)
    same = (labels[:, None] == labels[None, :]) & ~np.eye(len(labels), dtype=bool)
    top = sim.max(1, keepdims=True)
    e = np.exp(sim - top)
    if hardness > 0:
        other = labels[:, None] != labels[None, :]
        w = np.where(other, np.exp(hardness * (embeddings @ embeddings.T)), 1.0)
        w = np.where(other, w / np.maximum(np.where(other, w, 0).sum(1, keepdims=True), 1e-12) * np.maximum(other.sum(1, keepdims=True), 1), 1.0)
        e = e * w
    log = sim - top - np.log(e.sum(1, keepdims=True))
    held = same.sum(1) > 0
    return float(-(np.where(same, log, 0).sum(1)[held] / same.sum(1)[held]).mean()) if held.any() else 0.0


def balanced_batches(labels: np.ndarray, per_label: int, batches: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Row numbers of batches with ``per_label`` rows of each label, drawn with replacement where it has fewer."""
    rng = np.random.default_rng(seed)
    rows = {v: np.flatnonzero(labels == v) for v in np.unique(labels)}
    for _ in range(batches):
        yield np.concatenate([rng.choice(r, per_label, replace=len(r) < per_label) for r in rows.values()])


def disordered(df: DataFrame, sequence: str, load: Callable[[], Model], threshold: float = 0.5) -> DataFrame:
    """``df`` with disorder_fraction, disorder_class and disorder_regions, from a model's per-residue scores."""
    scored = predict(df, sequence, load, "s__", "array<double>")
    found = sequences.regions(F.col("s__"), threshold)
    covered = F.aggregate(found, F.lit(0), lambda s, r: s + r["end"] - r["start"])
    share = F.when(F.size("s__") > 0, covered / F.size("s__")).otherwise(0.0)
    return scored.withColumns({"disorder_fraction": share, "disorder_class": sequences.disorder_class(share), "disorder_regions": sequences.regions_text(found)}).drop("s__")


def embed_missing(df: DataFrame, sequence: str, load: Callable[[], Model], path: str, key: str = "id") -> int:
    """Append the embeddings of rows that the table at ``path`` lacks, so that a broken build goes on where it stopped; gives their number. Sequences are batched by length."""
    from capsidora.sources import sinks

    ordered = df.select(key, sequence).repartitionByRange(F.length(F.coalesce(F.col(sequence), F.lit("")))).sortWithinPartitions(F.length(sequence))
    return sinks.append_missing(predict(ordered, sequence, load, "embedding", "array<float>").select(key, "embedding"), path, key)


def answers(df: DataFrame, prompt: Column, ask: Callable[[], Model], categories: list[str]) -> DataFrame:
    """``df`` with category and reason from a language model behind an interface: its answer is JSON, perhaps within fences; a category that isn't listed, or an answer that isn't JSON, gives null."""
    told = predict(df.withColumn("p__", prompt), "p__", ask, "a__", "string")
    return told.withColumns(parsed_answer(F.col("a__"), categories)).drop("p__", "a__")


def parsed_answer(answer: Column, categories: list[str]) -> dict[str, Column]:
    bare = F.trim(F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    fields = F.from_json(bare, "category string, reason string")
    name = F.lower(F.trim(fields["category"]))
    return {"category": F.when(name.isin(categories), name), "reason": fields["reason"]}


def rescued_terms(terms: DataFrame, ask: Callable[[], Model]) -> DataFrame:
    """query, go_id of flagged terms that a model calls plausible: asked once a query, with all its terms; its answer is a JSON list of GO ids, of which only those asked about count."""
    held = terms.groupBy("query").agg(F.sort_array(F.collect_set("go_id")).alias("ids"))
    told = predict(held.withColumn("p__", F.concat_ws("\n", F.col("query"), F.array_join("ids", "\n"))), "p__", ask, "a__", "string")
    bare = F.trim(F.regexp_replace("a__", r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    kept = F.array_intersect("ids", F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>")))
    return told.select("query", F.explode(kept).alias("go_id"))


_FLIP = str.maketrans("ACGT", "TGCA")


def reading_frames(contigs: DataFrame, least: int = 90) -> DataFrame:
    """Genes of contigs (contig, sequence): in each of six frames, from the first start codon to the stop, at least ``least`` bases; a plain stand-in for a gene caller."""
    start, stop = re.compile("ATG|GTG|TTG"), {"TAA", "TAG", "TGA"}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for contig, s in zip(f.contig, f.sequence, strict=True):
                for strand, text in ((1, s), (-1, s.translate(_FLIP)[::-1])):
                    for frame in range(3):
                        begin = None
                        for i in range(frame, len(text) - 2, 3):
                            codon = text[i : i + 3]
                            if begin is None and start.match(codon):
                                begin = i
                            elif codon in stop:
                                if begin is not None and i + 3 - begin >= least:
                                    a, b = (begin + 1, i + 3) if strand == 1 else (len(text) - i - 2, len(text) - begin)
                                    rows.append((contig, a, b, strand, None, "frames"))
                                begin = None
            yield pd.DataFrame(rows, columns=schemas.GENE.names)

    return contigs.select("contig", "sequence").mapInPandas(scan, schemas.GENE)
