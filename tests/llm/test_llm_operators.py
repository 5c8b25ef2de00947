"""Operators on small tables with odd rows: nulls, empty texts, ties, repeats, clashing columns."""

import hashlib

import public_tokenizers
import pytest
from plain_forms import masked, plain_spans
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contentloom.llm import (
    classifier,
    components,
    decontamination,
    html_text,
    length_histogram,
    line_rules,
    packing,
    secret_ledger,
    sharding,
    simhash,
    warc,
)
from contentloom.llm.queries import fresh_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 501}" for i in range(40_000))
TEXTS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, "one two three four five six seven"),
    (4, "one two three four five six seven"), (None, "a b c"), (5, LONG), (6, " \n\t "), (None, None), (7, "é ü 漢字 \U0001f600 x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns of names that the operators use themselves.
    rows = [(i, t, 1, "x", 2.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, digest string, fp double")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_warc(spark):
    big, other = "x" * 200, "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    pages = [
        (3, "u3", big), (1, "u1", big), (1, "u1", big), (2, None, None), (4, "a b\r\nc", ""), (None, "n", big),
        (7, "z", other), (9, "z", other), (8, "s", "short"), (6, "s", "short"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    archive = warc.Archive(spark, fresh_folder(spark, "warc"))
    warc.write_archive(df, archive)
    records = warc.read_records(archive)
    got = rows_of(records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))

    def sha(text):
        return hashlib.sha256((text or "").encode()).hexdigest()

    want = [
        (3, "revisit", 1, 200, sha(big)), (1, "response", None, 200, sha(big)), (1, "revisit", 1, 200, sha(big)),
        (2, "response", None, 0, sha("")), (4, "response", None, 0, sha("")), (None, "revisit", 1, 200, sha(big)),
        (7, "response", None, 134, sha(other)), (9, "revisit", 7, 134, sha(other)), (8, "response", None, 5, sha("short")),
        (6, "response", None, 5, sha("short")),
    ]
    assert got == sorted(want, key=repr)
    assert archive.payloads().count() == 4
    assert rows_of(records.select("page_id", "payload")) == sorted(((p, (h or "").encode()) for p, _, h in pages), key=repr)

    # The files hold the same records, by their own lengths.
    folder = fresh_folder(spark, "files")
    warc.export_files(archive, folder)
    found = []
    for row in spark.read.format("binaryFile").load(f"{folder}/part-*").collect():
        left = bytes(row.content)
        while left:
            head, _, left = left.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            block, end, left = left[:size], left[size : size + 4], left[size + 4 :]
            assert end == b"\r\n\r\n"
            payload = block.partition(b"\r\n\r\n")[2]
            if fields[b"WARC-Type"] == b"response":
                assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
            else:
                assert payload == b""
            found.append(fields[b"WARC-Type"])
    assert sorted(found) == [b"response"] * 6 + [b"revisit"] * 4

    empty = warc.Archive(spark, fresh_folder(spark, "warc"))
    warc.write_archive(df.limit(0), empty)
    assert warc.read_records(empty).count() == 0


def test_warc_never_returns_a_wrong_payload(spark):
    archive = warc.Archive(spark, fresh_folder(spark, "warc"))
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), archive)
    spoilt = spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, payload binary")
    spoilt.write.mode("append").parquet(f"{archive.folder}/payloads")
    assert archive.payloads().where("NOT verified").count() == 1
    assert [r.payload for r in warc.read_records(archive).collect()] == [b"text"]


SECRETS = [
    (1, 'é password = "abcdef" and token: short AKIA' + "B" * 16),
    (2, "secret=token:abcdefgh"), (3, None), (4, ""), (5, "PASSWD:'a/b+c=d' api_key=x api-key=123456 apikey=" + "0a" * 12),
    (6, "AKIA" + "C" * 15 + " AKIAAKIA" + "D" * 20), (7, "0123456789abcdef" * 3 + "g" + "f" * 23),
    (8, "secret=token:abcdefgh"), (None, "secret=token:abcdefgh"), (8, "secret=token:abcdefgh"), (9, "secret: " * 300 + "abcdefg"),
]
def test_secret_ledger(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in SECRETS], "doc_id long, text string, digest string")
    ledger = secret_ledger.Ledger(spark, fresh_folder(spark, "ledger"))
    base = secret_ledger.BASE_RULES
    got = secret_ledger.scan(df, ledger, base)
    want = sorted(((i, plain_spans(t)) for i, t in SECRETS), key=repr)
    assert sorted(((r.path, [tuple(s) for s in r.spans]) for r in got.collect()), key=repr) == want

    # A second scan finds all seen, more rules scan the blobs for the new rules alone.
    before = ledger.read("scanned").count()
    assert before == 3 * len({t or "" for _, t in SECRETS})
    assert sorted(((r.path, [tuple(s) for s in r.spans]) for r in secret_ledger.scan(df, ledger, base).collect()), key=repr) == want
    assert ledger.read("scanned").count() == before
    more = (*base, secret_ledger.Rule("é", "é"))
    spans = {r.path: [s.rule for s in r.spans] for r in secret_ledger.scan(df, ledger, more).collect()}
    assert spans[1] == ["é", "assign", "access"]
    assert ledger.read("scanned").count() == before * 4 // 3
    # A lost job's findings are found again and count once.
    ledger.add("findings", ledger.read("findings").coalesce(1))
    assert {r.path: [s.rule for s in r.spans] for r in secret_ledger.scan(df, ledger, more).collect()} == spans
    assert secret_ledger.scan(df.limit(0), ledger).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in SECRETS], "doc_id long, text string, blob_spans string")
    got = secret_ledger.redact(df, secret_ledger.Ledger(spark, fresh_folder(spark, "ledger")), secret_ledger.BASE_RULES)
    assert got.columns == df.columns

    assert rows_of(got) == sorted(((i, masked(t), "x") for i, t in SECRETS), key=repr)


@pytest.mark.parametrize("limit", [30, 500])
def test_shards(docs, nothing, limit):
    rows = sharding.shard(docs, limit).collect()
    assert sorted((r.id for r in rows), key=repr) == sorted((i for i, _ in TEXTS), key=repr)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        size = sum(r.doc_bytes for r in own)
        assert (size, len(own)) == (own[0].shard_bytes, own[0].shard_docs)
        assert size <= limit or (len(own) == 1 and own[0].oversized)
    for prefix in shards:
        assert not any(other != prefix and other.startswith(prefix) for other in shards)
        if prefix:  # the bucket it was split from was too large
            around = [r for other, own in shards.items() if other.startswith(prefix[:-1]) for r in own]
            assert sum(r.doc_bytes for r in around) > limit
    assert sharding.shard(nothing, limit).count() == 0


def test_shards_of_one_key(spark):
    same = spark.range(300).select(F.lit(5).alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.shard(same, 100).collect()
    assert len(rows) == 300 and all(r.shard_bytes <= 100 and r.depth > 64 for r in rows)


@pytest.mark.parametrize("limit", [40, 10_000_000])
def test_written_shards(spark, docs, nothing, tmp_path, limit):
    path = str(tmp_path / "shards")
    hot = spark.range(200).select(F.lit(5).alias("doc_id"), F.concat(F.lit("x" * 9), "id").alias("text"))
    rows = docs.unionByName(hot, allowMissingColumns=True).withColumn("shard", F.lit("mine"))
    for _ in range(2):  # written again, nothing is there twice
        shards = {r.prefix: r for r in sharding.write_shards(rows, path, limit).collect()}
    written = spark.read.parquet(path)
    assert rows_of(written.drop("shard_").select(rows.columns)) == rows_of(rows)
    files = {}
    for r in written.select("text", "shard_", F.input_file_name().alias("file")).collect():
        files.setdefault((r["shard_"], r.file), []).append(len((r.text or "").encode()))
    assert sorted(f[0] for f in files) == sorted("b" + p for p in shards)  # one file for each shard
    for (name, _), sizes in files.items():
        shard = shards[name[1:]]
        assert (sum(sizes), len(sizes)) == (shard.bytes, shard.docs)
        assert sum(sizes) <= limit or (len(sizes) == 1 and shard.oversized)
    assert sharding.write_shards(nothing, path, limit).count() == 0


def test_extract(spark):
    pages = [(1, "u", "<article><p>a</article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", "<article><p>a</article>", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    want = sorted([(1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0), (1, "u", "a", 1)], key=repr)
    assert rows_of(html_text.extract(df)) == want
    assert html_text.extract(df.limit(0)).count() == 0


def test_pack(spark, docs, nothing):
    whole = Tokenizer.from_file(PATH)
    rows = packing.pack(spark, docs, PATH, window=64, shard_docs=3, with_ids=True).collect()
    pieces = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        pieces.setdefault(r.sequence_id, []).append(r)
    for own in pieces.values():
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert size == 64 or size & (size - 1) == 0
    got = {}
    for r in sorted(rows, key=lambda r: (repr(r.id), r.start)):
        got.setdefault((r.id, r.doc_tokens), []).append(r.ids)
    for i, text in TEXTS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        copies = sum(1 for j, t in TEXTS if (j, t) == (i, text))
        mine = [x for part in got[i, len(ids)] for x in part]
        assert len(mine) == copies * len(ids) and sorted(mine) == sorted(ids * copies)
    assert packing.pack(spark, nothing, PATH).count() == 0


def test_decontaminate(spark, docs, nothing):
    items = [(1, "One two, three four FIVE six seven"), (2, None), (3, ""), (None, "é ü 漢字"), (4, "not there at all, this one")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, id string")
    leaks = decontamination.find_leaks(spark, docs, bench, words_at_once=8)
    want = [(1, 1, 0, 7, 1.0), (4, 1, 0, 7, 1.0), (4, 1, 0, 7, 1.0), (7, None, 0, 3, 1.0)]
    assert rows_of(leaks) == sorted(want, key=repr)
    kept = decontamination.drop_leaks(spark, docs, bench)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [2, 3, None, 5, 6, None]))
    assert decontamination.find_leaks(spark, nothing, bench).count() == 0
    assert decontamination.find_leaks(spark, docs, bench.limit(0)).count() == 0


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 105), (103, 105), (101, 103), (7, 7), (None, 3), (200, 200)]
    got = dict(rows_of(components.components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, 101, 103, 105], 100), 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups(spark, docs, nothing):
    got = sorted(((r.id, r.component) for r in simhash.near_groups(docs).collect()), key=repr)
    want = [(1, 1), (2, 2), (3, 2), (4, 1), (4, 1), (None, None), (5, 5), (6, 2), (None, 2), (7, 7)]
    assert got == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 2, None, None, 5, 7]))
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.drop_near_duplicates(docs.where("doc_id = 4")).count() == 1


def test_links_of_hot_buckets(spark):
    """Chunks of a large bucket lose no link."""
    values = [(a << 40) | (b << 50) for a in range(16) for b in range(16)] + [1 << 20, 1 << 62]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.links(df, 3, cell=10)
    assert found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    got = dict(rows_of(components.components(found)))
    assert set(got.values()) == {0} and len(got) == len(values)


def test_line_rules(spark, docs, nothing):
    field = line_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = {r.id: r for r in line_rules.apply_rules(spark, docs, field).collect()}
    assert (rows[1].n_words, rows[1].base_failed, rows[1].kept) == (7, True, False)
    assert (rows[5].n_words, rows[5].n_repeat_words, rows[5].base_failed, rows[5].kept) == (40_000, 40_000, True, False)
    assert (rows[2].n_words, rows[6].n_words, rows[7].word_chars) == (0, 0, 6)
    assert line_rules.apply_rules(spark, nothing, field).count() == 0


def test_length_answers(docs, nothing):
    whole = Tokenizer.from_file(PATH)
    lengths = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    sums = length_histogram.length_answers(docs, PATH)
    for r in sums.collect():
        k = r.context_limit
        assert (r.docs, r.docs_longer) == (lengths.count(k), sum(n > k for n in lengths))
        assert (r.tokens_truncated, r.tokens_total) == (sum(min(n, k) for n in lengths), sum(lengths))
        assert r.tokens_up_to == sum(n for n in lengths if n <= k)
    limits = [0, 5, 6, 50_000, 10**9]
    got = rows_of(length_histogram.at_limits(sums, limits))
    assert got == sorted(((k, sum(n > k for n in lengths), sum(min(n, k) for n in lengths)) for k in limits), key=repr)
    shares = rows_of(length_histogram.quantiles(sums, [0.1, 1.0]))
    assert shares == [(0.1, min(lengths)), (1.0, max(lengths))]
    empty = length_histogram.length_answers(nothing, PATH)
    assert empty.count() == 0
    assert rows_of(length_histogram.at_limits(empty, [5])) == [(5, 0, 0)]


def test_quality(spark, docs, nothing):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.fit(docs, no_labels)
    assert {r.score for r in classifier.score(spark, docs, model).collect()} == {0.5}
    labels = [(i, 1 if i < 7 else 0) for i in (1, 4, 7)] + [(5, 0), (5, 1), (None, 1), (6, None)]
    model = classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = classifier.score(spark, docs, model)
    assert scores.count() == len(TEXTS) and scores.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert classifier.accepted(spark, docs, model, 0.0).columns == docs.columns
    assert rows_of(classifier.accepted(spark, docs, model, 0.0)) == rows_of(docs)
    assert classifier.accepted(spark, docs, model, 1.1).count() == 0
    assert classifier.score(spark, nothing, model).count() == 0
