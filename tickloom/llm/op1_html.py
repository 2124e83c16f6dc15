"""HTML main text: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches
from .html_blocks import Block, blocks
from .html_training import labelled_pages

#: Composed pages that the field is trained on, and passes over them.
PAGES, PASSES = 700, 6


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors; those nearer the block also by place."""
    out = {"bias"}
    for tag, tokens in path:
        out.add(f"in:{tag}")
        out.update(f"named:{t}" for t in tokens)
    for depth, (tag, tokens) in enumerate(reversed(path[-2:])):
        out.add(f"at{depth}:{tag}")
        out.update(f"at{depth}:named:{t}" for t in tokens)
    if not any(tokens for _, tokens in path):
        out.add("unnamed")
    return sorted(out)


def _bucket(n: float, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def text_features(b: Block, place: float, count: int) -> list[str]:
    text, size = b.text, len(b.text)
    words = text.count(" ") + 1
    density = b.linked / size if size else 0.0
    last = text[-1]
    return [
        f"chars:{_bucket(size, (8, 20, 40, 80, 160, 320, 640))}",
        f"words:{_bucket(words, (2, 4, 8, 16, 40, 100))}",
        f"linked:{_bucket(density, (0.01, 0.2, 0.5, 0.9))}",
        f"end:{last if last in '.!?:;,' else 'letter' if last.isalnum() else 'other'}",
        f"sign:{'©' in text}",
        f"digits:{_bucket(sum(map(str.isdigit, text)) / size, (0.01, 0.1, 0.3))}",
        f"place:{_bucket(place, (0.05, 0.25, 0.75, 0.95))}",
        f"blocks:{_bucket(count, (3, 8, 20, 60))}",
    ]


class BlockField:
    """Two labels, 1 article and 0 other: a weight for each feature and label (kept as the
    difference of the two) and one for each pair of neighbouring labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((2, 2))
        self._paths: dict[tuple, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "_paths": {}}

    def emissions(self, found: list[Block]) -> list[float]:
        get, out, n = self.weights.get, [], len(found)
        if len(self._paths) > 100_000:
            self._paths.clear()
        for i, b in enumerate(found):
            path = self._paths.get(b.path)
            if path is None:
                path = self._paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(path + sum(get(f, 0.0) for f in text_features(b, i / n, n)))
        return out

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi path."""
        (aa, ab), (ba, bb) = self.pairs.tolist()
        zero = one = 0.0
        back = []
        for i, e in enumerate(self.emissions(found)):
            if i:
                z = (zero + aa, 0) if zero + aa >= one + ba else (one + ba, 1)
                o = (zero + ab, 0) if zero + ab > one + bb else (one + bb, 1)
                zero, one = z[0], o[0] + e
                back.append((z[1], o[1]))
            else:
                one = e
        label = int(one > zero)
        out = [label] if found else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, rate: float = 0.25, ridge: float = 1e-4) -> None:
        """Adagrad ascent of the conditional log likelihood, page by page: observed less
        expected counts, the latter by the forward-backward recursion."""
        names = sorted({f for rows, _ in pages for r in rows for f in r})
        index = {f: i for i, f in enumerate(names)}
        w, g = np.zeros(len(names)), np.full(len(names), 1e-2)
        pair, gp = np.zeros((2, 2)), np.full((2, 2), 1e-2)
        data = [([np.array([index[f] for f in r]) for r in rows], np.array(y)) for rows, y in pages if rows]
        rng = np.random.default_rng(0)
        for _ in range(passes):
            for k in rng.permutation(len(data)):
                rows, y = data[k]
                n = len(rows)
                e = np.array([w[r].sum() for r in rows])
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                emit = np.stack([np.zeros(n), e], 1)
                fwd[0] = emit[0]
                for i in range(1, n):
                    fwd[i] = emit[i] + np.logaddexp(fwd[i - 1, 0] + pair[0], fwd[i - 1, 1] + pair[1])
                for i in range(n - 2, -1, -1):
                    step = emit[i + 1] + bwd[i + 1]
                    bwd[i] = np.logaddexp(pair[:, 0] + step[0], pair[:, 1] + step[1])
                total = np.logaddexp(*fwd[-1])
                p1 = np.exp(fwd[:, 1] + bwd[:, 1] - total)
                grad_pair = -1e-3 * pair
                if n > 1:
                    joint = np.exp(fwd[:-1, :, None] + pair[None] + (emit + bwd)[1:, None, :] - total)
                    grad_pair = grad_pair - joint.sum(0)
                    np.add.at(grad_pair, (y[:-1], y[1:]), 1.0)
                gp += grad_pair**2
                pair = pair + rate * grad_pair / np.sqrt(gp)
                flat = np.concatenate(rows)
                miss = np.repeat(y - p1, [len(r) for r in rows])
                touched, where = np.unique(flat, return_inverse=True)
                grad = np.bincount(where, miss) - ridge * w[touched]
                g[touched] += grad**2
                w[touched] += rate * grad / np.sqrt(g[touched])
        self.weights, self.pairs = dict(zip(names, w.tolist(), strict=True)), pair


def features(found: list[Block]) -> list[list[str]]:
    n = len(found)
    return [path_features(b.path) + text_features(b, i / n, n) for i, b in enumerate(found)]


def align(found: list[Block], labels: list[tuple[str, int]]) -> list[int]:
    """Labels of a composed page's blocks by their texts, in order."""
    out, at = [], 0
    for b in found:
        hit = next((i for i in range(at, len(labels)) if labels[i][0] == b.text), None)
        out.append(labels[hit][1] if hit is not None else 0)
        at = hit + 1 if hit is not None else at
    return out


@lru_cache(maxsize=2)
def fit_field(pages: int = PAGES, seed: int = 1) -> BlockField:
    """Trained on that many composed, labelled pages: a fixed, bounded set."""
    field, data = BlockField(), []
    for html, labels in labelled_pages(pages, seed):
        found = blocks(html)
        data.append((features(found), align(found, labels)))
    field.train(data)
    return field


def main_text(html: str | None, field: BlockField) -> str:
    found = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(found, field.decode(found), strict=True) if keep)


def extract(pages: DataFrame, field: BlockField | None = None, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with text string (the main text, blocks joined by two
    newlines; empty if none) and n_chars long (its code points).

    Null html counts as empty. Pages are taken whole, by themselves: repeated rows, ties and
    other columns need no rule; columns of `pages` named text or n_chars are replaced. One
    map over Arrow batches, no shuffle; the model is some thousand weights.
    """
    text_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or fit_field())
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).alias("_html"))

    def run(batches):
        for b in batches:
            out = [main_text(h, shared.value) for h in b.column(len(kept)).to_pylist()]
            cols = [*b.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract over all of `pages`."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
