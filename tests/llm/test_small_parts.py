"""Parts that need no session, against plain restatements."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from contentloom.llm import classifier, decontamination, html_text, line_rules, packing, simhash, tokens

TEXT = st.text(st.sampled_from("ab AB\t\n\r\v\f.é#|&̇ \x85"), max_size=60)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def plain_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 100)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("n", [2, 40, 600])
def test_group_links_reach_all_within_the_radius(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(n // 8, 1), dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(8))]))

    def parts(pairs):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(int(a))] = find(int(b))
        groups = {}
        for v in root:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a in values for b in values if a < b and bin(int(a ^ b)).count("1") <= 3]
    found = simhash.group_links(values)
    assert all(bin(int(a ^ b)).count("1") <= 3 for a, b in found)
    assert len(found) < len(values)
    assert parts(found) == parts(near)
    cells = np.zeros(len(values), np.int64)
    assert parts(simhash._links_of_cells(cells, values, 3, small=10_000)) == parts(near)


def plain_counts(text):
    words = words_of(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    met = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(met)


@given(st.one_of(TEXT, st.lists(st.sampled_from(["a", "b"]), max_size=60).map(" ".join)))
@settings(max_examples=200, deadline=None)
def test_line_rule_counts(text):
    m = line_rules.measure(text.encode(), len(text))
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain_counts(text)
    assert len(m.features) == len(m.line_words) and sum(m.line_words) == m.n_words


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(0)
    for _ in range(30):
        field = line_rules.Field(rng.normal(size=(2, 9)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(rng.integers(1, 8), 9))

        def total(labels, x=x, field=field):
            own = sum(x[t] @ field.weights[y] for t, y in enumerate(labels))
            return own + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(([n >> t & 1 for t in range(len(x))] for n in range(2 ** len(x))), key=total)
        assert total(field.label(x)) == pytest.approx(total(best))


def test_field_learns_runs():
    rng = np.random.default_rng(1)
    sequences = []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 4), 5)
        x = rng.normal(size=(20, 9))
        x[:, 1] += 2 * y
        sequences.append((x, y))
    field = line_rules.train_field(sequences)
    right = np.mean([np.mean(np.array(field.label(x)) == y) for x, y in sequences])
    assert right > 0.9 and field.steps[0, 0] > field.steps[0, 1]


def test_classifier_in_stretches(monkeypatch):
    text = " ".join(f"wörd{i} x" for i in range(300)) + "  y y y \n z"
    whole = np.sort(np.concatenate(list(classifier.features(text))))
    monkeypatch.setattr(classifier, "STRETCH", 50)
    parts = list(classifier.features(text))
    assert len(parts) > 10
    assert np.array_equal(np.sort(np.concatenate(parts)), whole)


def test_classifier_learns():
    good = [f"the {i} green hill and river" for i in range(60)]
    bad = [f"BUY {i}!! CHEAP!! NOW!!" for i in range(60)]
    model = classifier.train(good + bad, [1] * 60 + [0] * 60)
    assert model.score("a river and the hill") > 0.8 > 0.2 > model.score("CHEAP!! CHEAP!!")
    assert 0 <= model.score("") <= 1
    assert classifier.train([], []).score("x") == 0.5


def plain_leaks(items, text, threshold=0.8):
    def shingles(words):
        size = min(5, len(words))
        return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))

    words = re.findall(r"\w+", text.lower())
    found = []
    for item, source in items:
        own = re.findall(r"\w+", source.lower())
        best = None
        for start in range(len(words) - len(own) + 1 if own else 0):
            a, b = shingles(words[start : start + len(own)]), shingles(own)
            both = sum((a & b).values())
            sim = both / (sum(a.values()) + sum(b.values()) - both)
            if sim >= threshold and (best is None or sim > best[2]):
                best = (start, start + len(own), sim)
        if best:
            found.append((item, *best))
    return found


def test_leaks_are_all_found():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 50)))) for i in range(40)] + [(98, ""), (99, " .. ")]
    index = decontamination.Index(items, 0.8, 24)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 4)):
            words = items[rng.integers(0, 40)][1].split()
            for _ in range(rng.integers(0, 3)):  # near copies
                words[rng.integers(0, len(words))] = "changed"
            parts += [" ".join(rng.choice(["un", "known"], 5)), " ".join(words)]
        text = "\n".join(parts).upper()
        assert index.leaks(text) == plain_leaks(items, text)
    assert decontamination.Index([], 0.8, 24).leaks("some words") == []


@given(st.lists(st.text(st.sampled_from("aB é\t\n.'s1<|endoftext|>\x1c "), max_size=40), max_size=5))
@settings(max_examples=100, deadline=None)
def test_tokens_word_by_word(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    own = tokens.encoder(path)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packed_windows_are_full():
    rng = np.random.default_rng(5)
    docs = [rng.integers(3, 60, n).astype("<u2") for n in [*rng.integers(1, 90, 200), 64, 128, 700]]
    packer = packing.Packer(64)
    packing.pack_shard(packer, docs[:100], 0, np.ones(60), 40.0)
    packing.pack_shard(packer, docs[100:], 100, np.ones(60), 40.0)
    packer.close()
    sizes = [sum(n for _, _, n in sequence) for sequence in packer.done]
    assert all(size & (size - 1) == 0 and size <= 64 for size in sizes)
    assert sum(size < 64 for size in sizes) <= 6
    pieces = sorted(p for sequence in packer.done for p in sequence)
    for at, ids in enumerate(docs):
        expected = 0
        for _, start, n in (p for p in pieces if p[0] == at):
            assert start == expected
            expected += n
        assert expected == len(ids)


def test_neighbours_share_rare_words():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3], [9, 9, 8], [1, 2, 7], [8, 5, 5])]
    index = packing.Shard(docs, np.ones(10), 3.0)
    used = np.array([True, False, False, False])
    assert index.neighbours(0, used).tolist() == [2, 1, 3]
    assert index.neighbours(3, np.array([False, False, False, True])).tolist()[0] == 1


ARTICLE = "<h1>Title &amp; more</h1><p>First  long paragraph, of <a href=x>some</a>\nwords.<p>Second one<br>goes on &lt;here&gt;</p><ul><li>one<li>two</ul>"
WANT = "Title & more\nFirst long paragraph, of some words.\nSecond one goes on <here>\none\ntwo"
AROUND = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="comments-open">'
    '<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies for a good'
    ' reason, which takes a long text to tell.</div>%s<!-- <p>hidden</p> --><aside>Side</aside><div id="sidebar-left"><p>Other text</p></div>'
    "<section class='reader comments'><p>I liked this article a lot, thank you so much for it.</p></section><form><p>Name</p><input></form>"
    "<footer>End</footer></body></html>"
)


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<main>{ARTICLE}</main>",
        f"<div><div class=content>{ARTICLE}</div></div>",
        f"<article><header>{ARTICLE[:25]}</header><div class=text>{ARTICLE[25:]}</div><div class=ad>Buy</div></article>",
        f"<form>{'<div>'}<article>{ARTICLE}</article></div></form>",
    ],
)
def test_main_text(body):
    assert html_text.main_text(AROUND % body) == WANT


def test_main_text_of_odd_pages():
    assert [html_text.main_text(x) for x in (None, "", "  ", "just text", "<p>a", "x < y", "<script>a", "<p>&nbsp;</p>")] == [
        "", "", "", "just text", "a", "x < y", "", "",
    ]
    whole = AROUND % f"<article>{ARTICLE}</article>"
    for end in range(0, len(whole), 7):
        html_text.main_text(whole[:end])


@pytest.mark.parametrize("part", ["<b>", "<p>", "<div>", "<li>", "<a href='", "x<br>", "<tr><td>", "</x>", '<a "', "<!--", "<ul><li>", "<article>", "<article><h2><a>x"])
def test_main_text_of_malformed_pages_is_fast(part):
    html_text.main_text(part * 50_000 + "end")
