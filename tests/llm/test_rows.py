"""Stages of the pipeline judge rows, not ids."""

from contentloom.llm import decontamination, secret_ledger
from contentloom.llm.queries import fresh_folder
from contentloom.operators.keyfilter import KeyFilter


def test_leaks_go_by_row(spark):
    item = "one two three four five six seven eight"
    rows = [(1, f"start {item} end"), (1, "a clean text of the same id"), (None, item), (None, "clean"), (2, None), (3, "nine ten eleven twelve"), (3, "")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, row int").coalesce(1)
    bench = spark.createDataFrame([(1, item), (2, "not there at all"), (3, "nine ten eleven twelve")], "item_id long, text string")
    for words_at_once in (500_000, 6):
        kept = decontamination.drop_leaks(spark, docs, bench, words_at_once=words_at_once)
        assert kept.columns == docs.columns
        assert sorted(r.row for r in kept.collect()) == [1, 3, 4, 6]
    assert decontamination.drop_leaks(spark, docs, bench.limit(0)).count() == len(rows)


def test_a_second_scan_moves_no_text(spark):
    docs = spark.createDataFrame([(i, f"text {i} token=abcdef{i}") for i in range(50)], "doc_id long, text string")
    ledger = secret_ledger.Ledger(spark, fresh_folder(spark, "ledger"))
    first = sorted(map(repr, secret_ledger.scan(docs, ledger).collect()))
    rows = []
    add = ledger.add
    ledger.add = lambda name, df: (rows.append((name, df.count())), add(name, df))
    assert sorted(map(repr, secret_ledger.scan(docs, ledger).collect())) == first
    # Nothing is scanned, as the filter over unseen blobs lets no text pass.
    assert dict(rows) == {"scanned": 0, "findings": 0}
    todo = spark.createDataFrame([], "digest string")
    texts = docs.withColumn("digest", secret_ledger.digest_of(docs["text"]))
    assert KeyFilter(todo, "digest").maybe_wanted(texts).count() == 0


def test_key_blocks_leave_nothing_behind(spark):
    body = "\n".join(f"MIIE{i:060d}" for i in range(30))
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\nAb==\n-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN PRIVATE KEY-----\r\n{body}"
    docs = spark.createDataFrame([(1, f"see {block}, and more"), (2, f"cut {cut} off"), (3, "a -----BEGIN PUBLIC KEY----- b")], "doc_id long, text string")
    ledger = secret_ledger.Ledger(spark, fresh_folder(spark, "ledger"))
    got = {r.doc_id: r.text for r in secret_ledger.redact(docs, ledger).collect()}
    mark = secret_ledger.MARK
    assert got == {1: f"see {mark}, and more", 2: f"cut {mark} off", 3: "a -----BEGIN PUBLIC KEY----- b"}
