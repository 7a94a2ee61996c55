"""Quality rules and secret spans against plain Python."""

import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter

from llm_cases import DOCS, documents, encoded, frame, prose

from pixelkin.llm import host_quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rows = documents()
    rows.append((900, "a b c d e f a b c d e f a b c d e " * 3, *[None] * 7))
    rows.append((901, "a b c d e\n\n \na b c d e\r\na b c d e\x85\nx #|<>", *[None] * 7))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r.doc_id, *(r[n] for n in names), r.base_failed) for r in host_quality.quality(frame(spark, rows)).collect())
    expected = Counter()
    for r in rows:
        m = measures(r[1])
        expected[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == expected
    assert host_quality.quality(spark.createDataFrame([], DOCS)).count() == 0


def test_hosts_condemn_only_their_own_faults(spark):
    rng = random.Random(3)
    good = lambda: prose(rng, 40)
    bad = lambda: "| ".join(good().split(" "))
    rows = [(k, bad() if k % 10 else good(), None, "dump", *[None] * 5) for k in range(60)]
    rows += [(100 + k, good(), None, f"site{k % 3}", *[None] * 5) for k in range(60)]
    rows += [(200, bad(), None, "site0", *[None] * 5), (201, bad(), None, "tiny", *[None] * 5), (202, good(), None, None, *[None] * 5)]
    judged = {r.doc_id: r for r in host_quality.quality(frame(spark, rows)).collect()}
    kept = {k: r.kept for k, r in judged.items()}
    assert not any(kept[k] for k in range(60) if k % 10) and all(kept[k] for k in range(0, 60, 10))
    assert all(kept[100 + k] for k in range(60)) and kept[200] and kept[202]
    rates = {(r.host, r.rule): r.rate for r in host_quality.host_rates(host_quality.measured(frame(spark, rows))).collect()}
    assert (judged[1].host_fails, judged[1].host_condemned) == ("symbols", "symbols") and judged[0].host_fails == ""
    assert (judged[200].host_fails, judged[200].host_condemned) == ("symbols", "")
    assert all(judged[k].rate_symbols == round(rates[host, "symbols"], 6) for k, host in ((0, "dump"), (201, "tiny"), (202, None)))
    # One document says little about its host.
    assert rates["dump", "symbols"] > rates["tiny", "symbols"] > rates["site1", "symbols"]


def test_base_spans(spark):
    texts = [r[1] for r in documents()] + [
        "token=token:abcdefg", 'API_key" : "aaaaaa', "apikey=12345", "ſecret=abcdefgh", "é AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 15,
        "a" * 24 + "g" + "b" * 23, "\U0001f600 token = zzzzzz \U0001f600" + "f" * 30, "secret=" + "x" * 9000, "token: abcdef " * 700,
        "passwd='q.w=e-r_t' Secret:'short' SECRET:longer1",
    ]
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, text in enumerate(texts):
        expected = base_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), text[:80]
        assert set(expected.split(",")) - {""} <= set(got[k].spans.split(","))
        assert got[k].n_hex == expected.count("hex:") and got[k].n_assign == expected.count("assign:")
        starts = [int(s.split(":")[1]) for s in got[k].spans.split(",") if s]
        assert starts == sorted(starts)
    assert secret_scan.find_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_randomness_tells_keys_from_words(spark):
    rng = random.Random(12)
    url = string.ascii_letters + string.digits + "-_"
    keys = [encoded(rng, size, letters) for size in (40, 64, 120) for letters in (url, string.ascii_letters + string.digits) for _ in range(4)]
    plain = [w * 6 + "42" for w in ("release-", "aaaabbbb", "abcdefgh", "test_case_")] + ["internationalization" * 2, "2024-01-01-2024-02-02-2024-03-03"]
    plain += ["x1" * 20, "a" * 39 + "1", "0123456789abcdefghijklmnopqrstuvwxyz"]
    rows = [(k, f"{prose(rng, 6)} {t} {prose(rng, 6)}", *[None] * 7) for k, t in enumerate(keys + plain)]
    got = {r.doc_id: r.n_random for r in secret_scan.find_secrets(frame(spark, rows)).collect()}
    assert sum(got[k] for k in range(len(keys))) >= 0.85 * len(keys)
    assert sum(got[k] for k in range(len(keys), len(rows))) == 0


def test_keys_beside_names_and_in_mixed_alphabets(spark):
    value = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = {
        f"AWS_SECRET_ACCESS_KEY={value}": value, "session=Zk39fhQ81LmPz0aXcV7bnT2yR5": "Zk39fhQ81LmPz0aXcV7bnT2yR5",
        "sha256-Zk39fh+81LmPz0/XcV7bnT2yR5q": "Zk39fh+81LmPz0/XcV7bnT2yR5q", "=Zk39fhQ81LmPz0aXcV7bnT2yR5==": "Zk39fhQ81LmPz0aXcV7bnT2yR5==",
        "Zk39+hQ81-mPz0/XcV7_nT2y": "Zk39+hQ81-mPz0/XcV7_nT2y", "a=b=zzzzyyyy1" + "z" * 30: None,
    }
    rows = [(k, f"some é {t} words", *[None] * 7) for k, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(frame(spark, rows)).collect()}
    for k, (text, key) in enumerate(texts.items()):
        spans = [s.split(":") for s in got[k].split(",") if s]
        assert [s[0] for s in spans] == ["random"] * (key is not None), text
        assert key is None or int(spans[0][1]) <= 7 + text.index(key) <= 7 + text.index(key) + len(key) <= int(spans[0][2]), text
    clean = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows)).collect()}
    assert clean[0] == "some é AWS_SECRET_ACCESS_KEY=[secret] words" and clean[1] == "some é session=[secret] words"


def words_bound(text: str, k: int) -> float:
    kind = lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3
    total = math.log(1 / 4)
    for at, c in enumerate(text):
        if at:
            total += math.log(0.7 if kind(text[at - 1]) == kind(c) else 0.1)
        usual = secret_scan.FREQUENCIES[string.ascii_lowercase.index(c.lower())] / sum(secret_scan.FREQUENCIES) if c.isalpha() else 0
        total += math.log(0.8 * usual + 0.2 / 26 if c.isalpha() else 0.1 if c.isdigit() else 0.25)
    return min(1.0, len(secret_scan.ENCODINGS) * math.exp(total) * k ** len(text))


def test_bound_for_words(spark):
    rng = random.Random(9)
    texts = [encoded(rng, n) for n in (20, 33, 80)] + ["RecipesGuideEnergyGrowthNorth40", "some-page_name-of-2024-and-more"]
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    got = {r.doc_id: r._tested for r in secret_scan.scanned(frame(spark, rows)).collect()}
    for k, text in enumerate(texts):
        p = words_bound(text, 64 if "-" in text else 62)
        assert got[k][0][0].word_step == min(math.floor(-math.log10(max(p, 1e-40)) * secret_scan.STEPS), 800), text


def test_reports_are_not_names(spark):
    rng = random.Random(5)
    words = "Recipes Guide Energy Growth North Water Table Market Garden Summer Policy Report Science Travel Review".split()
    names = ["".join(rng.sample(words, 5)) + str(rng.randrange(100)) for _ in range(200)]
    names += ["-".join(rng.sample(words, 5)).lower() + f"-{rng.randrange(2030)}" for _ in range(100)]
    ids = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(60)]
    keys = [encoded(rng, rng.choice([24, 32, 40])) for _ in range(40)]
    rows = [(k, f"see {t} here", *[None] * 7) for k, t in enumerate(names + ids + [x.upper() for x in ids[:20]] + keys)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame(spark, rows)).collect()}
    assert sum(got[k].n_random for k in range(300)) <= 0.05 * 300
    found = [got[k].n_random + got[k].n_hex for k in range(300, len(rows))]
    assert sum(found[:80]) >= 0.85 * 80 and sum(found[80:]) >= 0.85 * 40
    whole = [got[300 + k].spans for k, x in enumerate(ids)]
    assert whole.count("random:4:40") >= 0.85 * 60


def test_redaction(spark):
    rows = [(1, "my token=abcdefgh! " + "0" * 40, *[None] * 7), (2, "token: " + "a" * 30, *[None] * 7), (3, None, *[None] * 7), (4, "clean", *[None] * 7)]
    got = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows)).collect()}
    assert got == {1: "my [secret]! [secret]", 2: "[secret]", 3: None, 4: "clean"}
