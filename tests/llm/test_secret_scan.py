import hashlib
import re

from lexivec.llm import queries, secret_scan

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
TEXTS = [
    None, "", "plain words", "token = 'abcdef'", "token = 'abc' secret: x", "secret: token = abcdefgh", "token=token=abcdef",
    "\U0001f600 API_KEY:\"zzzzzz\" apikey=1234567", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 9, "xAKIA" + "Z9" * 20 + " AKIASHORT",
    "0123456789abcdef01234567", "0123456789abcdef0123456", "password = " + "0a" * 20 + " é " + "ff" * 12, "a" * 5000 + " TOKEN: qwerty",
    "paſsword=abcdefg toKen=abcdefg", "-----BEGIN RSA PRIVATE KEY----- x", "token = 'abcdef'",
]


def spans_of(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_matches_brute_force(spark, docs_of, tmp_path):
    docs_of([*enumerate(TEXTS), (None, "secret=abcdefg"), (3, TEXTS[3])]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_secret_scans(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    text = dict(enumerate(TEXTS)) | {None: "secret=abcdefg"}
    for r in rows:
        want = spans_of(text[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3)), r
        assert r.base_sha256 == digest(want)
    assert [r.spans for r in rows if r.doc_id == 16] == ["pem:0:31"]


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_secret_scans(spark, sf_dir).collect()
    assert len(rows) == len(text) and all(r.base_sha256 == digest(spans_of(text[r.doc_id])) for r in rows)


def test_ledger_is_incremental(spark, docs_of):
    one = docs_of([(1, "token=abcdef"), (2, "nothing"), (3, "token=abcdef")])
    _, first = secret_scan.scan_documents(one)
    assert first.count() == 2
    again, none = secret_scan.scan_documents(one, first)
    assert none.count() == 0 and {r.doc_id: len(r.spans) for r in again.collect()} == {1: 1, 2: 0, 3: 1}
    rules = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, "[0-9a-f]{6,}"), *secret_scan.RULES[3:])
    _, newer = secret_scan.scan_documents(one, first, rules)
    assert {tuple(r.rules) for r in newer.collect()} == {("hex@2",)} and newer.count() == 2


def test_a_ledger_of_other_rules(docs_of):
    """An earlier run's ledger, other versions and another order of rules: as a fresh scan, with unseen pairs alone scanned."""
    texts = {1: "0123456789abcdef" * 2, 2: "token=abcdef AKIA" + "Z" * 16, 3: "secret: " + "0f" * 40, 4: "none"}
    first = docs_of([(i, t) for i, t in texts.items() if i < 4])
    _, ledger = secret_scan.scan_documents(first)
    newer = (secret_scan.Rule("hex", 2, "[0-9a-f]{64,}"), *secret_scan.RULES[:2], secret_scan.Rule("word", 1, "none"))
    every = docs_of([*texts.items(), (5, texts[3])])
    found, added = secret_scan.scan_documents(every, ledger, newer)
    fresh, _ = secret_scan.scan_documents(every, rules=newer)

    def told(df):
        return {r.doc_id: r.s for r in df.select("doc_id", secret_scan.span_text(df["spans"], newer).alias("s")).collect()}

    assert told(found) == told(fresh) == {1: "", 2: "assign:0:12,access:13:33", 3: "assign:0:88,hex:8:88", 4: "word:0:4", 5: "assign:0:88,hex:8:88"}
    scanned = {tuple(sorted(r.rules)) for r in added.collect()}
    assert added.count() == 4 and scanned == {("hex@2", "word@1"), ("access@1", "assign@1", "hex@2", "word@1")}


def test_very_many_matches_in_one_text(docs_of):
    text = "é token=abcdef\n" * 3000
    docs = docs_of([(1, text), (2, text + "x")])
    found, _ = secret_scan.scan_documents(docs)
    spans = found.where("doc_id = 2").first().spans
    assert [(s.start, s.end) for s in spans] == [(15 * i + 2, 15 * i + 14) for i in range(3000)]
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()} == {1: "é [SECRET]\n" * 3000, 2: "é [SECRET]\n" * 3000 + "x"}


def test_redaction(docs_of):
    docs = docs_of([(1, "a token=abcdef b " + "0" * 30), (2, "clean"), (3, None), (4, "secret: " + "f" * 24 + "!")])
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert out[1].text == "a [SECRET] b [SECRET]" and out[1].n_chars == 21
    assert out[2].text == "clean" and out[3].text is None and out[4].text == "[SECRET]!"
    assert secret_scan.redact(docs).columns == docs.columns


def test_private_keys_go_with_their_body(docs_of):
    body = "\n".join(["MIIEow+/" * 8] * 30 + ["QkVHSU4="])
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    texts = [
        (f"a\n{begin}\n{body}\n{end}\nb", "a\n[SECRET]\nb"),
        (f"a {begin}\r\n{head}{body}\r\n{end} b", "a [SECRET] b"),
        (f"key = '{begin}\\nMIIEow+/MIIEow+/\\n{end}\\n'", "key = '[SECRET]\\n'"),
        (f"{begin}\n{body}\n\nThe end - of it", "[SECRET]\n\nThe end - of it"),
        (f"{begin}\n{head}{body}", "[SECRET]"),
        (f"{begin}\n{body}\n{begin}\n{body}\n{end}!", "[SECRET]\n[SECRET]!"),
        (f"{begin} x", "[SECRET] x"),
        (f"{begin}\n" + "- " * 200_000 + "x", "[SECRET]\n" + "- " * 200_000 + "x"),
    ]
    out = {r.doc_id: r.text for r in secret_scan.redact(docs_of([(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    for i, (_, want) in enumerate(texts):
        assert out[i] == want, (i, out[i][:300])
    assert {r.name for r in secret_scan.REDACTED_RULES} - {r.name for r in secret_scan.RULES} == {"pem@2"}


def test_empty(docs_of):
    found, added = secret_scan.scan_documents(docs_of([]))
    assert found.count() == 0 and added.count() == 0
