import hashlib
import re

from tunetally.llm import blob_ledger as L

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[1], L.BASE_KINDS.index(s[0])))


ODD = [
    "", None, "token", "token: token: abcdefghijklmnop", "password=token=abcdefghijklmnop x", 'API_KEY" = "abcdef123456',
    "apikey:short secret = 'longer/value+of.it=='", "AKIA" + "A" * 13 + " AKIA" + "B" * 14, "AKIAAKIA" + "C" * 16,
    "é" * 5 + " deadbeefdeadbeef " + "ü😀 token=" + "0123456789abcdef" * 2, "0123456789abcde", "x" + "f" * 40 + "g" + "1" * 16,
    "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", "deadbeefdeadbeef", "token=abcdefabcdefabcdef token=short token = 'x'",
    "a ghp_" + "Z" * 30 + " b", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
]


def test_spans_equal_brute_force(make_docs, sample_docs):
    docs = make_docs(*enumerate(ODD)).unionByName(sample_docs.withColumn("doc_id", sample_docs.doc_id + 1000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = L.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id], r.spans, said)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in L.BASE_KINDS]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    more = {r.doc_id: r.spans for r in rows}
    assert more[len(ODD) - 2] == "forge:2:36" and more[len(ODD) - 1].startswith("jwt:0:")


def test_ledger_scans_new_blobs_and_rule_versions_only(make_docs, spark):
    old = make_docs((1, "AKIA" + "A" * 20), (2, "plain"), (3, "plain"))
    ledger = L.scan_new(old)
    assert ledger.count() == 2
    new = make_docs((4, "plain"), (5, "token=abcdefghijklmnop"), (6, None))
    fresh = L.scan_new(new, ledger)
    assert fresh.count() == 2
    both = L.union_ledgers(ledger, fresh)
    assert L.scan_new(new.union(old), both).count() == 0
    newer = tuple(L.Rule("access", "AKIA[A-Z]+", 0, 3, 2) if r.kind == "access" else r for r in L.RULES)
    again = L.scan_new(old, both, newer)
    assert {tuple(r.scanned) for r in again.collect()} == {("access@2",)}
    versions = old.select("doc_id", L.blob_of().alias("blob"))
    found = {r.doc_id: r.spans for r in L.findings(versions, L.union_ledgers(both, again), newer).collect()}
    assert [tuple(s) for s in found[1]] == [("access", 0, 24)] and found[2] == [] and found[3] == []


def test_redacted_rows(make_docs):
    docs = make_docs((1, "x token=abcdefabcdefabcdef y"), (1, None), (None, "AKIA" + "A" * 16), (2, ""), (3, "clean é"))
    docs = docs.withColumns({"blob": docs.lang, "spans": docs.lang, "scanned": docs.doc_id})
    out = L.redact(docs)
    assert out.columns == docs.columns
    rows = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in out.collect())
    assert rows == [("1", "None", 0), ("1", "x [SECRET] y", 12), ("2", "", 0), ("3", "clean é", 7), ("None", "[SECRET]", 8)]
    assert L.redact(docs.limit(0)).count() == 0
    assert L.report(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(make_docs):
    plan = L.report(make_docs((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_private_keys_go_whole(make_docs):
    body = "\n".join("Ab1+" * 16 for _ in range(3000))
    rsa = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    locked = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n{body}\n-----END RSA PRIVATE KEY-----"
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v1.4.11 (GNU/Linux)\n\n{body}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----"
    texts = [rsa, locked, pgp, locked.replace("\n", "\r\n"), locked.replace("\n", " ")]
    docs = make_docs(*[(k, f"a {t} b, {t}\nc: d") for k, t in enumerate(texts)], (9, f"a {rsa[:50000]}"))
    out = {r.doc_id: r.text for r in L.redact(docs).collect()}
    assert out == {**{k: "a [SECRET] b, [SECRET]\nc: d" for k in range(len(texts))}, 9: "a [SECRET]"}


def test_markers_in_prose_stay(make_docs):
    texts = [
        "The line -----BEGIN RSA PRIVATE KEY----- starts a key file and you should never commit it to a repo. Next: more.",
        "See -----BEGIN PRIVATE KEY-----\nNote: this is prose, long and clean, on one line\nand more of it.",
        "-----BEGIN PRIVATE KEY----- internationalization of software, otherwise clean",
    ]
    docs = make_docs(*enumerate(texts))
    assert {r.doc_id: r.text for r in L.redact(docs).collect()} == dict(enumerate(texts))
    key = "-----BEGIN PRIVATE KEY-----\\n" + "Ab1+" * 16 + "\\nQ==\\n-----END PRIVATE KEY-----"
    cut = "x -----BEGIN PRIVATE KEY-----\n" + "Ab1+" * 16 + "\nAb1+/"
    out = {r.doc_id: r.text for r in L.redact(make_docs((1, f"a {key} b"), (2, cut), (3, cut + " and prose"))).collect()}
    assert out[1] == "a [SECRET] b" and out[2] == "x [SECRET]" and out[3] == "x [SECRET]Ab1+/ and prose"


def test_a_former_version_is_not_scanned_again(make_docs, monkeypatch):
    docs = make_docs(*enumerate(["plain", "AKIA" + "A" * 20, "plain", "token=abcdefghijklmnop", None, ""]), (None, "plain"))
    former = docs.where("doc_id % 2 = 0")
    scanned = []
    scan = L.scan_new

    def counted(versions, ledger=None, rules=L.RULES):
        out = scan(versions, ledger, rules)
        scanned.append(out.count())
        return out

    want = sorted(map(str, L.report(docs).collect()))
    monkeypatch.setattr(L, "scan_new", counted)
    for few in (0, 100):
        monkeypatch.setattr(L, "MAX_OPEN", few)
        assert sorted(map(str, L.report(docs, former).collect())) == want
    assert scanned == [2, 2] * 2


def test_texts_of_seen_blobs_are_not_shuffled(make_docs):
    docs = make_docs((1, "a"), (2, "b"), (3, "c"))
    ledger = L.updated(docs.where("doc_id < 3"))
    plan = L.scan_new(docs, ledger)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_very_long_text(make_docs):
    text = "und so weiter " * 80_000 + "token=abcdefabcdefabcdef " + "f" * 100_000
    row = L.report(make_docs((1, text))).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 2)
