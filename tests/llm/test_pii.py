import hashlib
import random
import re

from tidepack.llm.pii import KINDS, Slots, base_spans, bootstrap, masked, personal_data, redact

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(11)
    bits = ["a", "@", "b.c", ".", "_", "1.2.3.4", "300.1.1.1.1", " ", "4111 1111-1111 1111", "5", "-", "+1 (620) 555-8424", "+", "é", "x@y.z@w.v", "0001.2.3.004", "12345678901234567890", "(", "\n", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert base_spans(text) == brute(text), text


def test_results_and_discovery(spark):
    rng = random.Random(12)
    rows = [(1, None, 1), (2, "", 1), (3, "mail é a.b@c.org or 10.0.0.1 " + "x" * 200_000, 1), (4, "plain words only", 1)]
    for i in range(10, 30):
        rows.append((i, f"text {rng.random()} please write to u{i}@host{i}.org today", 1))
    rows += [(50, "so please write to root@intranet today", 1)] * 2 + [(51, "numbers 555 123 4567 elsewhere", 1), (52, "see user@localhost there", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = {}
    for r in personal_data(df).collect():
        assert got.setdefault(r.doc_id, r) == r
    for doc, text, _ in rows:
        base = brute(text or "")
        joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [got[doc][f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert got[doc].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(got[doc].spans.split(",")) or not base
    assert got[50].spans == "email:19:32" and got[50].n_email == 0
    assert got[51].spans == got[52].spans == got[4].spans == ""
    clean = {r.doc_id: r.text for r in redact(df.drop("key")).collect()}
    assert clean[50] == "so please write to [EMAIL] today" and clean[1] is None and clean[4] == "plain words only"
    assert clean[3].startswith("mail é [EMAIL] or [IP] xx")
    assert personal_data(df.limit(0)).count() == 0


def test_patterns_need_support_and_precision(spark):
    rows = [("email", True, i, ["L write to"]) for i in range(6)] + [("email", False, 90, ["L write to", "L seen by"])]
    rows += [("email", False, 100 + i, ["L seen by"]) for i in range(9)] + [("ip", True, i, ["L at host"]) for i in range(4)]
    found = spark.createDataFrame(rows, "kind string, seed boolean, instance long, patterns array<string>")
    assert [(r.pattern, r.kind) for r in bootstrap(found).collect()] == [("L write to", "email")]


def test_masked_merges_overlaps():
    assert masked("ab 123 cd", [(3, 2, 5), (4, 3, 6)]) == "ab [CARD] cd"


def test_slots_of_accepted_patterns_give_identifiers_of_any_form(spark):
    odd = ["root@intranet,", "(root@intranet)", "5551234567", "2001:db8::1"]
    rows = [(i, f"text {i} please write to u{i}@host{i}.org today") for i in range(200)]
    rows += [(300 + i, f"so please write to {x} today") for i, x in enumerate([*odd, "john at example dot com"])]
    # a context that other words share is not accepted
    rows += [(400 + i, f"we heard from v{i}@host{i}.org then") for i in range(10)] + [(500 + i, f"we heard from friend{chr(97 + i)} then") for i in range(10)]
    # new instances speak for a new pattern, whose slot is searched in the next round
    rows += [(600 + i, f"so please write to nick{chr(97 + i)} today") for i in range(12)] + [(700 + i, f"the handle of nick{chr(97 + i)} here") for i in range(12)] + [(800, "the handle of stranger here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in personal_data(df).collect()}
    assert [got[300 + i] for i in range(4)] == [[x.strip(",()")] for x in odd]
    assert "john at example dot com" in got[304]
    assert all(got[500 + i] == [] for i in range(10)) and got[800] == ["stranger"]
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[301] == "so please write to ([EMAIL]) today" and clean[304] == "so please write to [EMAIL] today" and clean[505] == texts[505]


def test_keys_are_found_where_keys_are(spark):
    rng = random.Random(4)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'some words token = "{key()}" more {i}') for i in range(20)]
    rows += [(100, 'some words token = "hunter2" more'), (101, f"a hash {key()} elsewhere"), (102, "ordinary words")]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret:20:60" in got[i].split(",") for i in range(20))
    assert got[100] == "secret:20:27" and got[101] == got[102] == ""


def test_slots_against_plain_search():
    rng = random.Random(5)
    vocab = ["a", "b", "c", "d7", "D8", "(e)"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [""]
    patterns = ["L a b", "L b b", "C a _ c", "C d0 _ a", "C c _ c"]
    want = dict.fromkeys(patterns, 0)
    for t in texts:
        w = [re.sub("[0-9]+", "0", x.lower()) for x in t.split()]
        for i in range(1, len(w)):
            if i > 1 and f"L {w[i - 2]} {w[i - 1]}" in want:
                want[f"L {w[i - 2]} {w[i - 1]}"] += 1
            for j in range(i, min(i + 5, len(w) - 1)):
                if f"C {w[i - 1]} _ {w[j + 1]}" in want:
                    want[f"C {w[i - 1]} _ {w[j + 1]}"] += 1
    search = Slots([(p, "email") for p in patterns])
    assert dict(zip(search.names, search.count(texts).tolist(), strict=True)) == want
