import datetime as dt
import re

from cardpulse.llm import pii
from hostile import empty, hostile


def run(spark, texts, key=pii.KEY):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(pii.pseudonymise(docs, key).collect(), key=lambda r: r["doc_id"])
    return [(r["text"], [(f["kind"], f["value"]) for f in r["found"]]) for r in rows]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_kinds_and_formats(spark):
    cases = {
        "email": "ann.lee_42@mail.example.com", "card": "4111 1111 1111 1111", "phone": "+1 (523) 555-1055", "address": "192.168.10.254",
        "date": "2023-02-28", "ssn": "078-05-1120", "iban": "DE89 3704 0044 0532 0130 00", "secret": "token = \"0641917ea4e9feb9cda83477b57ac2654884f485",
    }
    out = run(spark, [f"before {v} after" for v in cases.values()])
    for (kind, old), (text, found) in zip(cases.items(), out):
        assert [k for k, _ in found] == [kind] and text == f"before {found[0][1]} after"
        new = found[0][1]
        assert new != old
        if kind not in ("date", "address"):
            assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", new)).lower().count("9") + len(new) >= len(old)
            assert re.sub("[0-9a-zA-Z]", "x", new) == re.sub("[0-9a-zA-Z]", "x", old)
    assert luhn(out[1][1][0][1]) and all(0 <= int(o) <= 255 for o in out[3][1][0][1].split("."))
    dt.date.fromisoformat(out[4][1][0][1])
    iban = out[6][1][0][1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"


def test_invalid_values_stay(spark):
    texts = ["4111 1111 1111 1112", "999.1.1.1", "2023-02-30", "DE89370400440532013001", "123456", "version 1.2.3", "31/31/2020", None, ""]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_equal_values_are_linked_in_every_spelling(spark):
    out = run(spark, ["a 4111111111111111 b", "4111-1111-1111-1111!", "x 4111 1111 1111 1111", "(523) 555-1055", "+1 (523) 555-1055", "523-555-1055",
                      "2024-01-31", "01/31/2024", "31.01.2024"])
    digits = [re.sub(r"\D", "", f[0][1]) for _, f in out]
    assert len(set(digits[:3])) == 1 and len({d[-10:] for d in digits[3:6]}) == 1
    day = dt.date.fromisoformat(out[6][1][0][1])
    assert out[7][1][0][1] == day.strftime("%m/%d/%Y") and out[8][1][0][1] == day.strftime("%d.%m.%Y")


def test_permutations(spark):
    days = [dt.date(1800, 1, 1) + dt.timedelta(days=k) for k in range(0, 146_097, 37)]
    out = run(spark, [d.isoformat() for d in days])
    assert len({f[0][1] for _, f in out}) == len(days)
    ids = [f"{a:03d}-{b:02d}-{c:04d}" for a in range(3) for b in range(10) for c in range(40)]
    out = run(spark, ids)
    assert len({f[0][1] for _, f in out}) == len(ids)
    ips = [f"10.{a}.{b}.7" for a in range(40) for b in range(40)]
    assert len({f[0][1] for _, f in run(spark, ips)}) == len(ips)
    assert run(spark, ids[:5], "another key") != run(spark, ids[:5])


def test_several_in_a_text(spark):
    text = "a@b.example.com, 1.2.3.4\nand a@b.example.com; 4111111111111111\n5.6.7.8"
    (new, found), = run(spark, [text])
    assert [k for k, _ in found] == ["email", "address", "email", "card", "address"] and found[0] == found[2]
    assert new == "{}, {}\nand {}; {}\n{}".format(*(v for _, v in found))


def test_hostile_rows(spark):
    docs = hostile(spark)
    out = pii.pseudonymise(docs)
    assert out.columns == [*docs.columns, "found_"]
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in docs.collect())))
    assert pii.pseudonymise(empty(spark)).count() == 0


def test_numbers_beside_others(spark):
    card, iban = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    amex = "3782 822463 10005"
    cases = [(card, "{} 123"), (card, "{} 12/25"), (card, "12 {}"), (card, "{} 12 25 123"), (card, "1234 5678 9012 {}"), (card, "NO12 {}"),
             (card.replace(" ", ""), "12 {}"), (card.replace(" ", "-"), "{} 123"), (amex, "{} 1234"), ("9792 0303 9444 0796", "{} 123"),
             (iban, "{} EUR"), (iban, "{} BIC ABCD"), (iban, "{} 2024"), (iban.replace(" ", ""), "{} EUR"), ("NO93 8601 1117 947", "{}")]
    alone = [new for new, _ in run(spark, [v for v, _ in cases])]
    assert all(new != v for new, (v, _) in zip(alone, cases))
    out = run(spark, [around.format(v) for v, around in cases])
    for (v, around), new, (text, found) in zip(cases, alone, out):
        assert text == around.format(new) and [f[1] for f in found] == [new], around


def test_values_beside_a_number(spark):
    values = ["02/28/2023", "523-555-1055", "078-05-1120", "ann123@b.example.com", "5500000000000004"]
    alone = [new for new, _ in run(spark, values)]
    card, = [new for new, _ in run(spark, ["4111111111111111"])]
    assert [t for t, _ in run(spark, [f"4111111111111111 {v}" for v in values])] == [f"{card} {new}" for new in alone]
    assert run(spark, ["123 523-555-1055"])[0][0] == f"123 {alone[1]}"


def test_single_digits(spark):
    address, card = "8.8.8.8", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"
    alone = run(spark, [f"dns {address} ok", f"x = {address}", card, "4111111111111111"])
    assert [[k for k, _ in f] for _, f in alone] == [["address"], ["address"], ["card"], ["card"]]
    assert alone[0][1] == alone[1][1] and alone[0][0] == f"dns {alone[0][1][0][1]} ok"
    assert alone[2][0].replace("-", "") == alone[3][0]


def test_long_secrets(spark):
    long = "0641917ea4e9feb9cda83477b57ac265" * 10
    keys = [long[:300], "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", "sk_live_51HxQ2eKZvYw9", long * 60]
    out = run(spark, [f"token={k}" for k in keys] + [f'api_key: "{k}". b' for k in keys])
    for k, (text, found), (again, _) in zip(keys, out, out[len(keys):]):
        new = text.removeprefix("token=")
        assert [f for f, _ in found] == ["secret"] and re.sub("[0-9A-Za-z]", "x", new) == re.sub("[0-9A-Za-z]", "x", k)
        assert not any(new[i:i + 12] == k[i:i + 12] for i in range(0, len(k) - 12)) and again == f'api_key: "{new}". b'
    assert run(spark, ["token = request.headers.get('x')"])[0][1] == []
    assert [k for k, _ in run(spark, ["password: ann.lee.smith12@example.com"])[0][1]] == ["email"]


def test_a_long_text_of_numbers_takes_time_by_its_length(spark):
    import random
    import time

    rng = random.Random(5)
    text = " ".join(str(rng.randint(0, 9999)) for _ in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.pseudonymise(df).first()
    assert time.perf_counter() - began < 120
    assert len(row["found"]) > 1000 and len(row["text"]) == len(text)
    assert all(f["kind"] == "card" for f in row["found"])
