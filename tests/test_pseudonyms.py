import numpy as np

from meterflow.operators import pseudonyms as P
from meterflow.operators.leaks import WIDTHS, grams, values_in


def test_bodies_keep_their_shape_and_values_do_not_meet(spark):
    body = '# HELP m at 10.1.2.3\nm{user="Ab-9\\"}é",k="v,}1"} 1\nbroken{user="x\n\nplain 2'
    raw = spark.createDataFrame([("f", body), ("g", None), ("h", "")], "file string, body string")
    values = P.corpus_label_values(raw)
    assert sorted((r.label, r.value) for r in values.collect()) == [("k", "v,}1"), ("user", 'Ab-9\\"}é')]
    denied = P.denied_values(values, ["k"], P.public_vocabulary(values, ["k"], ["user"]))
    out = P.pseudonymize_bodies(raw, denied, P.pseudonym_map(denied), ["k"])
    got = {r.file: r.body for r in out.collect()}
    assert got["g"] is None and got["h"] == "" and len(got["f"].encode()) == len(body.encode())
    assert got["f"].split("\n")[2:] == body.split("\n")[2:] and 'k="v,}1"' in got["f"]
    assert {r.token for r in P.leak_scan(out, P.high_risk_values(values, ["user"]), ["k"]).collect()} == {"10.1.2.3"}
    leaked = P.leak_scan(spark.createDataFrame([("f", "# is ééé")], "file string, body string"), spark.createDataFrame([("ééé",)], "value string"), ["k"])
    assert [tuple(r) for r in leaked.collect()] == [("f", "value", "ééé")]


def test_pseudonyms_are_injective(spark):
    df = spark.range(1000).selectExpr("lpad(cast(id as string), 3, '0') AS value").union(spark.sql("SELECT explode(array('', 'a', null, 'a'))"))
    rows = P.pseudonym_map(df).collect()
    assert len(rows) == 1002 and len({r.pseudonym for r in rows}) == 1002 and all(len(r.value) == len(r.pseudonym) for r in rows)
    assert sum(r.value == r.pseudonym for r in rows) < 20


def test_every_place_has_its_own_digest(spark):
    """A place is moved by a digest of its number: no two places of a long value move together for all keys."""
    import hashlib

    value = "a" * 120

    def shifted(half, other, r):
        return "".join(chr(97 + (ord(c) - 97 + int(hashlib.md5(f"0|{r}|{i}|{other}".encode()).hexdigest()[:8], 16)) % 26) for i, c in enumerate(half, 1))

    a, b = value[:60], value[60:]
    for r in range(4):
        a, b = (shifted(a, b, r), b) if r % 2 else (a, shifted(b, a, r))
    assert P.pseudonym_map(spark.createDataFrame([(value,)], "value string")).first().pseudonym == a + b


def test_bodies_take_digests_by_place(spark):
    """In a body, places of one letter that lie 25 apart are moved by digests of their own, not by steps of one roll."""
    raw = spark.createDataFrame([(str(i), f'm{{id="{"0" * 400}{i:02d}"}} 1') for i in range(20)], "file string, body string")
    denied = P.denied_values(P.corpus_label_values(raw), [], P.public_vocabulary(P.corpus_label_values(raw), [], []))
    got = [r.body.split('"')[1] for r in P.pseudonymize_bodies(raw, denied, P.pseudonym_map(denied), []).collect()]
    steps = {(int(v[i + 25]) - int(v[i])) % 10 for v in got for i in range(170)}
    assert len(set(got)) == 20 and len(steps) == 10


def test_blanks_and_commas_do_not_leak(spark):
    plain, spaced = 'm{a="x1y2",b="secret99"} 1', 'm{ a = "x1y2" ,\tb="secret99" , } 1'
    raw = spark.createDataFrame([("p", plain), ("s", spaced), ("c", '  # m{a="x1y2"}\nm{} 1\nm{ } 1')], "file string, body string")
    values = P.corpus_label_values(raw)
    assert sorted((r.file, r.label, r.value) for r in values.collect()) == [(f, k, v) for f in "ps" for k, v in (("a", "x1y2"), ("b", "secret99"))]
    denied = P.denied_values(values, [], P.public_vocabulary(values, [], []))
    got = {r.file: r.body for r in P.pseudonymize_bodies(raw, denied, P.pseudonym_map(denied), []).collect()}
    assert got["c"] == '  # m{a="x1y2"}\nm{} 1\nm{ } 1'
    a, b = got["p"].split('"')[1::2]
    assert got["s"] == spaced.replace("x1y2", a).replace("secret99", b) and "secret99" not in got["p"] + got["s"] and "x1y2" not in got["p"] + got["s"]


def test_values_are_found_by_their_grams(spark):
    """Against a plain search: values of all lengths at the start, the end and inside, hot grams, other alphabets, line breaks."""
    import random

    rng = random.Random(9)
    text = lambda n, of="ab1": "".join(rng.choice(of) for _ in range(n))
    values = [text(n) for n in (4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100) for _ in range(4)] + ["日本", "日本語の", "a\nb1", "aaaa1", "é9é9", "ab1", "zz99zz"]
    bodies = [(f"f{i}", text(300)) for i in range(60)] + [("g", None), ("h", ""), ("s", values[0]), ("u", "x日本語のy é9é9 a\nb1")]
    bodies += [(f"p{i}", text(50) + v + text(rng.randrange(3))) for i, v in enumerate(values)] + [("h", values[9]), (None, "in " + values[20])]
    clean = spark.createDataFrame(bodies, "file string, body string").repartition(5)
    secrets = spark.createDataFrame([(v,) for v in [*values, None, "", values[0], "word"]], "value string")
    want = {(f, v) for f, b in bodies for v in values if b and len(v.encode()) >= 4 and v in b}
    assert {tuple(r) for r in values_in(clean, secrets).collect()} == want and len(want) > 60
    assert values_in(clean, secrets.where("value = 'nowhere'")).count() == 0 and values_in(clean.where("false"), secrets).count() == 0


def test_gram_places():
    data = np.frombuffer(b"0123456789abcdef0123456789abcdefXYZ", np.uint8)
    for w, h in grams(data, WIDTHS):
        assert len(h) == len(data) - w + 1 and (h >= 0).all()
        assert all((h[i] == h[j]) == (data[i : i + w].tobytes() == data[j : j + w].tobytes()) for i in range(len(h)) for j in range(i))
    assert [w for w, _ in grams(data[:9], WIDTHS)] == [4, 8] and list(grams(data[:3], WIDTHS)) == []


def test_leak_scan_kinds(spark):
    clean = spark.createDataFrame([("f", "# abcd1 here xx9y 10.1.2.3"), ("g", None), ("h", "nothing"), ("k", 'm{k="00:1a:2B:3c:4d:5e",z="1.2.3.44"} 1')], "file string, body string")
    secrets = spark.createDataFrame([("abcd1",), ("xx9y",), ("zz99",), ("word",), (None,), ("nothing",)], "value string")
    assert {tuple(r) for r in P.leak_scan(clean, secrets, ["k"]).collect()} == {("f", "value", "abcd1"), ("f", "value", "xx9y"), ("f", "comment", "10.1.2.3"), ("k", "label", "00:1a:2B:3c:4d:5e")}
