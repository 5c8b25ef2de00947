"""Quality rules: counts over whole texts, and lines labelled by a linear-chain random field.

The base counts a text's words, symbols, repeated lines and repeated stretches of words, and
fails texts of few words or much repetition. The method labels each line as content or
boilerplate: a line's features (signs, capitals, digits, length, repetition) score the two labels
and neighbouring labels score each other; the best sequence is found by Viterbi decoding. A
document is kept if it passes the base and at least ``least_content`` of its words stand in
content lines.

The field is trained by maximum likelihood on the lines of a bounded sample of labelled documents
(``per_class`` of each class, see ``classifier.training_sample``); a line has its document's label,
but for repeated lines of good documents, which are boilerplate. Everything else reads whole texts.

Words are runs of characters other than ASCII white space. Lines end at line feeds; lines without
a word have no label.

Defined cases: a null or empty text has no words and fails the base. Repeated rows give equal
rows. Without labels of both classes, every line is content and the base alone decides.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from contentloom.llm.classifier import training_sample
from contentloom.llm.texts import in_batches, lengths, narrow, utf8

SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
WINDOW = 8
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(WINDOW)]
N_FEATURES = 9

# Kinds of bytes: 1 capital, 2 digit, 4 sign, 8 letter (any byte of a character beyond ASCII too).
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1 | 8
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 8
_KINDS[128:] = 8
_KINDS[[*b"0123456789"]] = 2
_KINDS[[*b"#*$%&|<>!@^~=+_{}[]\\/"]] = 4


@dataclass
class Text:
    """What the base and the field need to know of a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray  # a row for each line with a word
    line_words: list[int]


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k, factor in enumerate(_FACTORS):
        x = hashes[k : k + n] * factor
        windows += x ^ (x >> np.uint64(32))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + WINDOW, -1)
    return int((np.cumsum(twice) > 0).sum())


def measure(text: bytes, n_chars: int) -> Text:
    words = text.split()
    lines = text.split(b"\n")
    met: set[bytes] = set()
    at, starts, ends, counts, longest, repeats, again = 0, [], [], [], [], [], []
    for line in lines:
        own = line.split()
        if own:
            starts.append(at)
            ends.append(at + len(line))
            counts.append(len(own))
            longest.append(sum(map(len, own)) / len(own))
            repeats.append(1 - len(set(own)) / len(own))
            again.append(line in met)
            met.add(line)
        at += len(line) + 1
    features = np.zeros((len(starts), N_FEATURES))
    if starts:
        kinds = _KINDS[np.frombuffer(text, np.uint8)]
        cuts = np.array([starts, ends]).T.ravel()
        sums = [
            np.add.reduceat(np.append((kinds & kind) > 0, False), cuts, dtype=np.int64)[::2] for kind in (1, 2, 4, 8)
        ]
        size = np.array(ends) - np.array(starts)
        n = np.array(counts)
        features[:, 0] = 1
        features[:, 1] = sums[2] / n  # signs by word
        features[:, 2] = sums[0] / np.maximum(sums[3], 1)
        features[:, 3] = sums[1] / size
        features[:, 4] = np.log1p(n) / 5
        features[:, 5] = np.array(longest) / 10
        features[:, 6] = repeats
        features[:, 7] = again
        features[:, 8] = n < 4
    return Text(
        len(words),
        n_chars - len(text) + sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        sum(again),
        repeated_words(words),
        np.minimum(features, 3),
        counts,
    )


@dataclass
class Field:
    """Weights of the features and of neighbouring labels; label 1 is content."""

    weights: np.ndarray  # label, feature
    steps: np.ndarray  # label before, label

    def label(self, features: np.ndarray) -> list[int]:
        """The best sequence of labels (Viterbi); content wins ties."""
        if not len(features):
            return []
        scores = (features @ self.weights.T).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from0, from1 = (a + s00, a + s01), (b + s10, b + s11)
            back.append((int(from1[0] >= from0[0]), int(from1[1] >= from0[1])))
            a, b = max(from0[0], from1[0]) + x, max(from0[1], from1[1]) + y
        labels = [int(b >= a)]
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1]


def train_field(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 100, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam) over all sequences at once, padded."""
    sequences = [(f, y) for f, y in sequences if len(y)]
    width, n = max(len(y) for _, y in sequences), len(sequences)
    x, y, mask = np.zeros((n, width, N_FEATURES)), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for i, (f, labels) in enumerate(sequences):
        x[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = f, labels, True
    hot = np.eye(2)[y] * mask[..., None]
    seen_w = np.einsum("ntk,ntf->kf", hot, x)
    seen_s = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    total = mask.sum()
    w, s = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, s)]
    for step in range(1, steps + 1):
        e = x @ w.T
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = e[:, 0]
        for t in range(1, width):
            new = np.logaddexp(forward[:, t - 1, :1] + s[0], forward[:, t - 1, 1:] + s[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(width - 2, -1, -1):
            ahead = e[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(s[:, 0] + ahead[:, :1], s[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        marginal = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
        pair = forward[:, :-1, :, None] + s + (e + backward)[:, 1:, None, :] - norm[:, None, None, None]
        pairs = np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]
        slopes = (
            (seen_w - np.einsum("ntk,ntf->kf", marginal, x)) / total - decay * w,
            (seen_s - pairs.sum(axis=(0, 1))) / total - decay * s,
        )
        for p, slope, m in zip((w, s), slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.999 * m[1] + 0.001 * slope**2
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Field(w, s)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 500, max_chars: int = 10_000) -> Field:
    texts, quality = training_sample(docs, labels, label, per_class, max_chars)
    if len(set(quality)) < 2:
        return Field(np.zeros((2, N_FEATURES)), np.zeros((2, 2)))
    sequences = []
    for text, good in zip(texts, quality, strict=True):
        features = measure(text.encode(), len(text)).features
        sequences.append((features, np.where(features[:, 7] > 0, 0, good)))
    return train_field(sequences)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(text: Text, field: Field, least_words: int, most_repeated: int, least_content: float) -> tuple[bool, float, bool]:
    """Whether the base fails, the share of words in content lines, and whether the text is kept."""
    failed = text.n_words < least_words or 100 * text.n_repeat_words > most_repeated * text.n_words
    content = sum(n for n, label in zip(text.line_words, field.label(text.features), strict=True) if label)
    share = content / text.n_words if text.n_words else 0.0
    return failed, share, not failed and share >= least_content


def apply_rules(
    spark: SparkSession,
    docs: DataFrame,
    field: Field,
    least_words: int = 20,
    most_repeated: int = 30,
    least_content: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, the counts, ``base_failed``, ``content_share`` and ``kept`` of every row."""
    shared = spark.sparkContext.broadcast(field)

    def ruled(batches):
        field = shared.value
        for batch in batches:
            for part in in_batches(batch, 1):
                texts = [measure(t, n) for t, n in zip(utf8(part.column(1)), lengths(part.column(1)).tolist(), strict=True)]
                verdicts = [judge(t, field, least_words, most_repeated, least_content) for t in texts]
                columns = [pa.array([getattr(t, name) for t in texts], pa.int64()) for name in NAMES]
                columns += [pa.array([v[i] for v in verdicts]) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], names=["id", *NAMES, "base_failed", "content_share", "kept"]
                )

    rows = narrow(docs, id_col, text_col)
    counts = ", ".join(f"{name} long" for name in NAMES)
    return rows.mapInArrow(
        ruled, f"id {dict(rows.dtypes)['id']}, {counts}, base_failed boolean, content_share double, kept boolean"
    )
