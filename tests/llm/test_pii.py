import re

from pyspark.sql import functions as F

from commitlens.llm import pii


def swap(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.doc.text, list(r.kinds)) for r in sorted(pii.replace_entities(df, **options).collect(), key=lambda r: r.doc.doc_id)]


TEXTS = [
    "Write to Ann.Lee7@Mail7.example.com or +1 (319) 555-5132, card 4111111111111111 from 55.63.178.142.",
    "Dr. Anna Cole met Ms. Cole and John Cole; Иван Петров came. ann.lee7@mail7.example.com",
    None, "", "4111-1111-1111-1111 then 123-45-6789, DE89 3704 0044 0532 0130 00 ok",
    "x4111111111111111 12 2020-10-11 3.14159 12345678901234567890 1.2.3.4.5 version 2.0 of 300 things",
    "a@b.co a@b.co c@b.co", "no entity at all" * 3000]


def luhn(digits):
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def test_types_formats_and_coreference(spark):
    out = swap(spark, TEXTS)
    assert [k for _, k in out] == [["email", "phone", "card", "ip"], ["name", "name", "name", "name", "email"], [], [], ["card", "ssn", "iban"], [], ["email"] * 3, []]
    first = out[0][0]
    m = re.fullmatch(r"Write to ([A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@\w{5}\.example\.com) or (\+1 \(\d{3}\) \d{3}-\d{4}), card (4\d{15}) from ((?:\d+\.){3}\d+)\.", first)
    assert m and luhn(m[3]) and all(1 <= int(x) <= 254 for x in m[4].split("."))
    for old in ("Ann", "4111", "55.63", "555-5132"):
        assert old not in first
    assert out[1][0].endswith(m[1].lower())
    n = re.fullmatch(r"Dr\. (\w+) (\w+) met Ms\. (\w+) and (\w+) (\w+); (\w+) (\w+) came\. .*", out[1][0])
    assert n and n[2] == n[3] == n[5] and n[1] in pii.GIVEN["latin", "f"] and n[4] in pii.GIVEN["latin", "m"]
    assert n[6] in pii.GIVEN["cyrillic", "m"] and re.fullmatch(r"[А-Я][а-я]+", n[7])
    assert out[2][0] is None and out[3][0] == "" and out[5][0] == TEXTS[5] and out[7][0] == TEXTS[7]
    assert re.sub(r"\D", "", out[4][0].split(" then")[0]) == m[3]
    a, b, c = out[6][0].split()
    assert a == b != c
    assert swap(spark, TEXTS) == out and swap(spark, TEXTS, key="other") != out


def test_every_branch_alone_in_a_text(spark):
    alone = [("email", "a@b.co"), ("iban", "GB12 ABCD EFGH IJKL"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("card", "371449635398431"), ("ssn", "123-45-6789")]
    alone += [("phone", x) for x in ("+45 12 34 56 78", "+47 22 12 34 56", "+49 30 12 34 56", "+1 (31) 55 51", "+4512", "+45 12 34", "(319) 555-5132", "319.555.5132") if re.fullmatch(pii.PHONE, x)]
    alone += [("name", x) for x in ("Mrs. Cole", "Ms Cole", "Anna Cole", "Иван Петров")]
    assert len(alone) >= 17
    for (kind, value), (text, kinds) in zip(alone, swap(spark, [f"see {v} ok" for _, v in alone]), strict=True):
        assert kinds == [kind] and value not in text, value


def test_collisions_are_resolved(spark):
    """Local parts of one letter leave 26 surrogates for 20 entities of a domain: all must stay distinct, and none an original."""
    texts = [f"{c}@x.org and more" for c in "abcdefghijklm"] + ["a@x.org again"]
    out = [t.split()[0] for t, _ in swap(spark, texts)]
    assert len(set(out)) == 13 and out[0] == out[13]


def test_full_spaces_get_longer_surrogates(spark, monkeypatch):
    """All mailboxes of one letter in all domains of one letter: every surrogate of that shape is an original."""
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{a}@{b}.org" for a in letters for b in letters] + ["A@a.org"]
    out = [t for t, _ in swap(spark, texts)]
    assert len(set(out[:-1])) == 676 and not set(out) & set(texts) and out[-1].lower() == out[0]
    value = pii.surrogate(F.lit("phone"), F.lit("+1 12 34"), F.lit(3)).alias("v")
    assert re.fullmatch(r"\+1 \d\d \d\d-\d{4}", spark.range(1).select(value).first().v)


def test_one_family_stays_one(spark):
    """Ten given names with one surname, in one text and over texts: one new surname, as many given names, of the same gender."""
    given = pii.GIVEN["latin", "f"][:5] + pii.GIVEN["latin", "m"][:5]
    texts = [" and ".join(f"{g} Cole" for g in given) + " met Dr. Cole and Ms. Cole; Cole left, and Xander Cole stayed. The Cole house.", "Mr. Cole wrote", "Mr. Xavier Cole"]
    out = [t for t, _ in swap(spark, texts)]
    pairs = re.findall(r"(\w+) (\w+)", out[0].split(" met ")[0].replace(" and ", " , "))
    assert len(pairs) == 10 and len({b for _, b in pairs}) == 1 and len({a for a, _ in pairs}) == 10
    new = pairs[0][1]
    assert all(a in pii.GIVEN["latin", "f" if k < 5 else "m"] and a != given[k] for k, (a, _) in enumerate(pairs))
    assert "Cole" not in out[0] and "Xander" not in out[0] and f"Dr. {new} and Ms. {new}; {new} left" in out[0] and f"The {new} house" in out[0]
    assert out[1] == f"Mr. {new} wrote" and re.fullmatch(rf"Mr\. [A-Z][a-z]+ {new}", out[2]) and "Xavier" not in out[2]


def test_untitled_names(spark):
    texts = ["Xavier Cole came", "Name: Zed Quill", "contact is Zed Quill.", "Zed Quill", "Иван Петров", "The Quick Fox"]
    out = swap(spark, texts)
    assert [k for _, k in out] == [["name"], ["name"], ["name"], [], ["name"], []]
    assert all("Cole" not in t and "Xavier" not in t for t, _ in out) and out[1][0][6:] == out[2][0][11:-1] and out[3][0] == texts[3]


def test_mail_addresses_of_any_length_and_script(spark):
    long = "x" * 5000
    texts = [f"to {long}@a.org", "to josé.ñ@exämple.museum now", "-ann@x.org and ann@x.org", "иван@почта.рф", "a@" + "b." * 3000, "a." * 3000 + " @"]
    out = swap(spark, texts)
    assert [k for _, k in out] == [["email"], ["email"], ["email", "email"], ["email"], [], []]
    assert "xxxxx" not in out[0][0] and len(out[0][0]) == len(texts[0]) and "josé" not in out[1][0] and "exämple" not in out[1][0] and out[1][0].endswith(".museum now")
    a, b = re.fullmatch(r"-(\S+) and (\S+)", out[2][0]).groups()
    assert a == b and re.fullmatch(r"[а-я]{4}@[а-я]{5}\.рф", out[3][0])


def test_distinct_over_many_entities(spark):
    """10,000 entities of each of some types: distinct stay distinct, and none becomes another's original."""
    many = {
        "email": [f"u{i}@mail{i % 7}.org" for i in range(10_000)],
        "surname": [f"Ms. {chr(65 + i // 2600)}{chr(97 + i % 26)}{chr(97 + i // 26 % 100 % 26)}{chr(97 + i // 26 % 100 // 26)}z" for i in range(10_000)],
        "phone": [f"+1 {200 + i // 100} 55{i % 100:02d}" for i in range(10_000)],
    }
    values = [v for kind in many.values() for v in dict.fromkeys(kind)]
    out = [t for t, _ in swap(spark, [f"{v} ok" for v in values])]
    assert len(set(out)) == len(values) > 22_000 and not set(out) & {f"{v} ok" for v in values}


def test_given_names_are_a_permutation():
    new = pii.given_names()
    assert set(new) == {n for names in pii.GIVEN.values() for n in names} and all(a != b for a, b in new.items())
    assert all({new[n] for n in names} <= set(names) for names in pii.GIVEN.values())


def test_native_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "to a.b@c.org", "x")], "doc_id long, text string, found string").withColumn("new", F.lit(1)).withColumn("special", F.lit(2)).withColumn("pieces", F.lit(5)).withColumn("kinds", F.lit(3))
    out = pii.keep_columns(df)
    row = out.first()
    assert out.columns == df.columns and row.found == "x" and row.text != "to a.b@c.org" and row.kinds == 3
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert pii.keep_columns(df.limit(0)).collect() == []
