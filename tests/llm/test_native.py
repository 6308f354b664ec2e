"""Operators in DataFrame operations only, and the pipeline."""

import datetime
import ipaddress
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fundlake.llm import catalog, decontaminate, mixing, pseudonyms
from fundlake.llm.common import stored, table


def mixed_table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, target string")


def brute_targets(sizes):
    """Shares by weight; what exceeds three times a source's size is shared again until nothing does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, fixed = {}, float(sum(sizes.values())), set()
    while True:
        open_weight = sum(weight[s] for s in names if s not in fixed)
        target |= {s: left * weight[s] / open_weight for s in names if s not in fixed}
        above = [s for s in names if s not in fixed and target[s] > 3 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            fixed.add(s)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(900)]
    rows += [(901, None, "a"), (902, "", "b"), (None, "x y\tz", "a"), (903, "one two", "tiny"), (903, "one two", "tiny"), (904, " \n", "blank")]
    docs = mixed_table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    targets = brute_targets(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and math.isclose(r.target, targets[source], rel_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - targets[source]) <= max(r.size for r in own)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in want] == [
        (a, b, c, round(d, 6), e) for a, b, c, d, e in sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=repr)]


def test_mixing_of_nothing(spark):
    assert mixing.mix(mixed_table(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(mixed_table(spark, [(1, None, "a")])).collect()] == [0]


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def masked(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "doc_id long, text string, value string")
    return [r.text for r in pseudonyms.pseudonymised(docs, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["card 4539 1488 0343 6467 or 4539148803436467.", "born 1999-12-31, 31.12.1999, 12/31/1999", "mail jo.doe9@x1.example.com, 10.1.2.3",
             "+1 (417) 555-1301 and 123-45-6789", "DE89 3704 0044 0532 0130 00", "again jo.doe9@x1.example.com 1999-12-31"]
    card, born, mail, phone, iban, again = masked(spark, texts)
    a, b = re.fullmatch(r"card (4[0-9]{3} [0-9]{4} [0-9]{4} [0-9]{4}) or (4[0-9]{15})\.", card).groups()
    assert a.replace(" ", "") == b != "4539148803436467" and luhn(b)
    iso, dotted, slashed = re.fullmatch(r"born (\S+), (\S+), (\S+)", born).groups()
    day = datetime.date.fromisoformat(iso)
    assert f"{day:%d.%m.%Y}" == dotted and f"{day:%m/%d/%Y}" == slashed and iso != "1999-12-31"
    local, address = re.fullmatch(r"mail ([a-z]{2}\.[a-z]{3}[0-9])@x1\.example\.com, (\d+\.\d+\.\d+\.\d+)", mail).groups()
    assert local != "jo.doe9" and address != "10.1.2.3" and all(0 <= int(x) <= 255 for x in address.split("."))
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} and (?!123-45-6789)\d{3}-\d{2}-\d{4}", phone)
    account = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1 and len(iban) == len(texts[4])
    assert again == f"again {local}@x1.example.com {iso}"
    assert masked(spark, texts[:1], "other") != [card]


def test_what_is_not_personal_stays(spark):
    texts = [None, "", "no 12 numbers", "1234567890123456", "2000-02-30 and 10.0.0.300 and 1.2.3.4.5", "000-12-3456", "x" * 200_000 + " 10.0.0.1"]
    got = masked(spark, texts)
    assert got[:-1] == texts[:-1] and got[-1] != texts[-1] and got[-1].startswith("x" * 200_000)


def test_layouts_of_personal_values(spark):
    phones = ["+12125550123", "+1 212 555 0123", "212 555 0123", "+1-212-555-0123", "+1.212.555.0123", "1 212 555 0123", "(212)555-0123", "(212) 555 0123",
              "(212)5550123", "+1(212)5550123", "+1 (212) 555-0123", "212-555-0123", "212.555.0123"]
    world = ["+33 1 42 68 53 00", "+442071234567", "+44 (0)20 7123 4567", "+49-30-1234567"]
    mails = ["_jo.doe@x.com_", "-jo.doe@x.com", ".jo.doe@x.com", "+jo.doe@x.com", "%jo.doe@x.com", "<jo.doe@x.com>"]
    dates = ["1/5/1990", "1/05/1990", "01/05/1990", "5.1.1990", "05.01.1990", "1990-1-5", "1990/1/5", "1990-01-05"]
    values = phones + world + mails + dates
    got = masked(spark, [f"see {v} there" for v in values])
    assert [v for v, g in zip(values, got, strict=True) if v in g] == []
    assert all(g.startswith("see ") and g.endswith(" there") for g in got)
    new = dict(zip(values, (g[4:-6] for g in got), strict=True))
    assert all(re.sub("[0-9]", "0", new[v]) == re.sub("[0-9]", "0", v) for v in phones + world)
    assert len({re.sub("[^0-9]", "", new[v])[-10:] for v in phones}) == 1
    assert all(new[v].replace(new[mails[5]][1:-1], "jo.doe@x.com") == v for v in mails)
    days = {(int(y), int(m), int(d)) for v in dates for y, m, d in [
        (lambda p: (p[2], p[0], p[1]) if "/" in v and len(p[2]) == 4 else (p[2], p[1], p[0]) if "." in v else p)(re.split("[-./]", new[v]))]}
    assert len(days) == 1 and new["1990-01-05"] == "{:04d}-{:02d}-{:02d}".format(*next(iter(days)))
    assert not re.search(r"(?<![0-9])0[0-9]", new["1/5/1990"] + new["5.1.1990"] + new["1990-1-5"])
    assert masked(spark, ["+44 20 7123 4567 2024"])[0].endswith(" 2024") and "7123 4567" not in masked(spark, ["+44 20 7123 4567 2024"])[0]


def test_values_before_what_looks_like_a_further_group(spark):
    cards = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/27", "5500 0000 0000 0004 04/26", "4111-1111-1111-1111-12"]
    accounts = ["ES91 2100 0418 4502 0005 1332 BIC", "AT61 1904 3002 3457 3201 THIS", "AT611904300234573201 THIS IS", "DE89 3704 0044 0532 0130 00 FOR"]
    others = ["123 45 6789", "0001-01-01", "31.12.9999", "9800-02-28", "0199-12-31", "4111 1111 1111 1112 123"]
    got = [t[4:-6] for t in masked(spark, [f"see {v} there" for v in cards + accounts + others])]
    for value, new in zip(cards, got, strict=False):
        assert value[:19] != new[:19] and luhn(re.sub("[^0-9]", "", new[:19])) and value[19:] == new[19:]
    assert len({re.sub("[^0-9]", "", got[i])[:16] for i in (0, 1, 3)}) == 1
    for value, new in zip(accounts, got[4:], strict=False):
        plain = re.sub(" (BIC|THIS|THIS IS|FOR)$", "", new).replace(" ", "")
        assert new != value and new.split()[-1] == value.split()[-1]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[5].replace(" ", "") == got[6].replace(" ", "")[:24]
    ssn, *days, kept = got[8:]
    assert re.fullmatch(r"(?!123 45 6789)[0-9]{3} [0-9]{2} [0-9]{4}", ssn) and kept == others[-1]
    assert re.fullmatch(r"0[01]\d\d-\d\d-\d\d", days[0]) and re.fullmatch(r"\d\d\.\d\d\.9[89]\d\d", days[1])
    assert re.fullmatch(r"9[89]\d\d-\d\d-\d\d", days[2]) and re.fullmatch(r"0[01]\d\d-\d\d-\d\d", days[3])


def test_month_names_and_long_addresses(spark):
    days = ["12 March 1990", "March 12, 1990", "12 mar 1990", "MAR. 12 1990", "12th of March 1990", "12-Mar-1990", "March 12th, 1990", "1990-03-12"]
    addresses = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::ff00:42:8329", "FE80::1", "fe80::"]
    phones = ["tel: 2125550123", "Phone 2125550123", "call 2125550123", "phone number: 2125550123", "+12125550123"]
    accounts = ["de89370400440532013000", "DE89370400440532013000"]
    values = days + addresses + phones + accounts
    got = [t[4:-6] for t in masked(spark, [f"see {v} there" for v in values])]
    new = dict(zip(values, got, strict=True))
    assert [v for v in values if v in new[v]] == []
    day = datetime.date.fromisoformat(new["1990-03-12"])
    name, number = day.strftime("%B"), str(day.day)
    end = "th" if 11 <= day.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10, "th")
    year = str(day.year)
    assert got[:7] == [f"{number} {name} {year}", f"{name} {number}, {year}", f"{number} {name[:3].lower()} {year}", f"{name[:3].upper()}. {number} {year}",
                       f"{number}{end} of {name} {year}", f"{number}-{name[:3]}-{year}", f"{name} {number}{end}, {year}"]
    for a in addresses:
        assert ipaddress.ip_address(new[a]) != ipaddress.ip_address(a)
        assert [len(g) for g in new[a].split(":")] == [len(g) for g in a.split(":")]
    assert len({re.sub("[^0-9]", "", new[v])[-10:] for v in phones}) == 1 and new[phones[0]].startswith("tel: ")
    assert new[accounts[0]].upper() == new[accounts[1]] and new[accounts[0]].islower()
    stays = ["31 February 1990", "may 2010", "12 Marching 1990", "std::vector", "add::", "12:30:45", "order 2125550123", "ab12cdefghijklmnop", "1:2:3:4:5:6:7:8:9",
             "2001:1:2:3:4:5::6:7:8"]
    assert masked(spark, stays) == stays


def test_permutation_of_a_whole_domain(spark):
    rows = spark.range(1000).select(pseudonyms._digits_permuted("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("x"))
    assert sorted(r.x for r in rows.collect()) == [f"{i:03d}" for i in range(1000)]
    words = spark.createDataFrame([(f"{a}{b}",) for a in "abcdefghij" for b in "0123456789"], "w string")
    found = [r.x for r in words.select(pseudonyms._characters_permuted("k", "t", F.col("w")).alias("x")).collect()]
    assert len(set(found)) == 100 and all(re.fullmatch("[a-z][0-9]", x) for x in found)


def test_native_plans_have_no_python(spark, sf_dir):
    for key in ("op5_pii_pseudonyms", "op7_source_mixing"):
        plan = catalog.QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of every stage on the smallest tables."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stages(spark, sf_dir, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    columns = list(corpus_pipeline.COLUMNS)
    for name, before, after in stages:
        assert after.columns == columns + ["size", "repeats"] * (name == "mixing")
        if name not in ("personal_data", "mixing"):  # what stays is unchanged, row by row
            assert after.exceptAll(before.select(*columns)).count() == 0 < after.count() < before.count()
    labels = table(spark, sf_dir, "labels")
    clean = stages[0][1].join(labels.where("toxic = 0"), "doc_id").select("doc_id")
    assert clean.join(stages[0][2], "doc_id", "left_anti").count() == 0
    _, before, after = stages[2]
    hit = decontaminate.contamination(before, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    assert {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()} == {r.doc_id for r in hit.collect()}
    _, before, after = stages[3]
    assert before.count() == after.count()
    values = {r.value for r in pseudonyms.personal_values(before).where("kind <> 'card'").collect()}
    assert values and not values & {r.value for r in pseudonyms.personal_values(after).collect()}
    _, before, after = stages[4]
    assert 0 < after.count() <= before.count() and after.where("repeats not between 1 and 3").count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"pipeline", *catalog.QUERIES} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in catalog.QUERIES) == list(range(1, 14))


def test_empty_documents_are_not_repeated_beyond_their_rounds(spark):
    rows = [(i, "", "a") for i in range(30)] + [(100 + i, "one two three", "a") for i in range(5)] + [(200, "x " * 400, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(docs).collect()
    rounds = {r.source: int(r.target // r.source_size) for r in found}
    assert all(r.repeats <= rounds[r.source] for r in found if r.size == 0)
    assert all(r.repeats <= 3 for r in found)
