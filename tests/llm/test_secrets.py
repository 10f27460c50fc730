import base64
import hashlib
import random
import re

from tremorframe.llm import secrets_scan as sc

RX = {
    "assign": re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}


def brute(text):
    out = []
    for n, (kind, rx) in enumerate(RX.items()):
        group, least = LEAST[kind]
        out += [(m.start(), n, kind, m.end()) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice(["an", "er", "Th", "on", "sch", "ü", "é", "lich", "😀"]) for _ in range(r.randint(1, 12)))
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    texts, planted = [], []
    for k in range(400):
        t = [word() for _ in range(r.randint(1, 30))]
        t.append("src/main/module2/" + "/".join(r.choice(["java", "org", "util", "test"]) for _ in range(4)))
        if k % 4 == 0:
            a = [sc.ALPHABETS["base62"], sc.ALPHABETS["base64"], "0123456789ABCDEF"][k // 4 % 3]
            t.insert(r.randrange(len(t)), s := pick(a, 40) + "7")
            planted.append((k, s))
        if k % 5 == 0:
            t += [r.choice(["Password", "api_key", "APIKEY", "token"]) + r.choice(["=", ": ", '"  :  \'', " = "]) + pick("abcDEF012./=", r.choice([3, 7, 8, 30]))]
            t += ["AKIA" + pick("ABC123", r.choice([11, 12, 16])), pick("0123456789abcdef", r.choice([31, 32, 64]))]
        texts.append(" ".join(t))
    texts += [None, "", "secret=token =abcdefgh", "xAKIAAKIA" + "A" * 12, "😀😀 token:12345678", "tokentoken=abcdefgh", "a" * 300000, "AKIA" * 5, "TOKEN='secret=abcdefgh", "ſecret=abcdefgh", "toKen=abcdefgh"]
    return texts, planted


def test_spans(spark):
    texts, planted = corpus()
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "password=abcdefgh", 0), (3, texts[0], 0)]
    got = sc.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    by = {g.doc_id: g for g in got if g.doc_id != 3}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        if k == 3:
            continue
        want, g = brute(t), by[k]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[0] == kind for x in want) for kind in RX), (k, t)
        assert g.base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        mine = [x for x in g.spans.split(",") if x and not x.startswith("random:")]
        assert mine == [f"{a}:{b}:{c}" for a, b, c in want]
        for x in g.spans.split(","):
            if x.startswith("random:"):
                a, b = map(int, x.split(":")[1:])
                assert any(c.isdigit() for c in t[a:b])
    caught = sum(f"random:{texts[k].index(s)}:{texts[k].index(s) + len(s)}" in by[k].spans for k, s in planted)
    short_hex = sum("random:" in x and re.fullmatch("[0-9a-f]{31}", texts[k][int(x.split(":")[1]) : int(x.split(":")[2])]) is not None for k, g in by.items() if k is not None for x in g.spans.split(","))
    false = sum(g.n_random for g in by.values()) - caught - short_hex
    assert caught >= 0.85 * len(planted) and false <= 0.1 * caught


def test_encodings_and_empty(spark):
    raw = random.Random(1).randbytes(60)
    texts = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), base64.b32encode(raw).decode(), raw.hex(), "1" * 40, "abcdefghij" * 4, "0123456789abcdef" * 3]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", sc.candidates(__import__("pyspark").sql.functions.col("text")).alias("c")).collect()
    by = {r.doc_id: [(c.encoding, c.p) for c in r.c] for r in got}
    assert [by[k][0][0] for k in range(4)] == ["base64", "base64", "base32", "hex"] and by[4] == by[5] == []
    assert all(by[k][0][1] > 1e-3 for k in range(4)) and by[6][0][1] < 1e-6
    assert sc.secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_values_after_a_name(spark):
    r = random.Random(12)
    pick = lambda n: "".join(r.choice(sc.ALPHABETS["base62"]) for _ in range(n - 1)) + "7"
    names = ["DB_AUTH=", "key=", "https://a.example/?user=x&sig=", "export MY_LONG_VARIABLE_NAME_2="]
    keys = [pick(44) for _ in range(200)] + [pick(200)]  # the last one is alone in its length
    texts = [f"word {names[k % 4]}{v} word" for k, v in enumerate(keys)]
    got = {g.doc_id: g.spans for g in sc.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = [f"random:{texts[k].index(v)}:{texts[k].index(v) + len(v)}" in got[k].split(",") for k, v in enumerate(keys)]
    assert sum(caught) >= 0.85 * len(keys) and caught[-1]
