import random

import pytest

from veritrail.llm.personal import personal_spans, redacted, reliabilities

PEOPLE = ["Nikhil Tarvelo", "Zoé Ramisko", "GRACE PELTOMA", "olaf wendrik", "Anna O'Tarvelo", "Jan van Ramisko", "Will Peltoma", "Rose Wendrik", "Mark Tarvelo"]
EMAILS = ["nora.s@mail.example", "nora_s at mail dot example", "NORA+X@MAIL.EXAMPLE.ORG", "nora [at] mail[dot]example", "nora(at)mail.example", "nora @ mail.example"]
PHONES = ["+44 20 7946 0371", "(202) 555-0124", "202-555-0169 ext. 837", "00 61 2 5550 2463", "+49 (0)30 23125 096", "030/23125-408", "+12025550156", "+33 1 99 00 33 77"]
IDS = ["XE0947247", "QQ928549D", "QQ 83 23 67 D", "34981546P", "87735178-L", "959-34-9706", "02 164 989 173"]
PLACES = ["Flat 35, 93-95 Gullhaven St", "98 osierfield close", "92, quai Morvance", "138 Gullhaven Court, Apt 28B", "114-116 Candlewick St, ZZ3 2QP", "Am Steinbruchsee 36a, 00345", "Calle Ferrolán 169, 5.º B", "Lindwurmallee 165"]
FORMS = [
    ("Listed owner {}, {}", ("person", "address")), ("My manager is {} ({}).", ("person", "phone")), ("You can reach me at {} from tomorrow.", ("email",)), ("record 79727293 holder {} doc {}", ("person", "id_number")),
    ("If I don't answer, text {} on {}.", ("person", "phone")), ("Please copy {} on anything about it.", ("person",)), ("The address is {} now.", ("address",)), ("I gave them passport {} at the desk.", ("id_number",)),
]
DECOYS = ["Order 2677-4255 shipped this morning.", "Parcel 739-43-439 is at the depot.", "Will the survey fit into 24 pages?", "Mark the Tuesday entry as done.", "The rose beds need water.", "We run build 71.22.249 on the Sylph X. Use port 5670.", "Ping me @ 10:00 if it slips.", "Invoice 82167097 is open.", "We leave at dawn on Friday.", "Version 5.1, section 18-84-4186, page 850."]
POOL = {"person": PEOPLE, "email": EMAILS, "phone": PHONES, "id_number": IDS, "address": PLACES}


@pytest.fixture(scope="module")
def corpus():
    rng, data, want = random.Random(2), [], set()
    for i in range(700):
        text = ""
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5:
                text += rng.choice(DECOYS) + rng.choice([" ", "\n"])
                continue
            form, kinds = rng.choice(FORMS)
            picked = [rng.choice(POOL[k]) for k in kinds]
            start, parts = len(text), form.split("{}")
            for part, kind, value in zip(parts, kinds, picked):
                start += len(part)
                want.add(("s", i, start, start + len(value), kind))
                start += len(value)
            text += form.format(*picked) + rng.choice([" ", "\n"])
        data.append(("s", i, text, "junk"))
    return data, want


SCHEMA = "src string, rec_id long, text string, kind string"


def test_spans_and_placeholders(spark, corpus):
    data, want = corpus
    df = spark.createDataFrame(data + data[:9] + [("s", 9000, None, ""), ("s", 9001, "", ""), ("s", 9002, "plain words " * 20_000, "")], SCHEMA)
    spans = personal_spans(df)
    found = {tuple(r) for r in spans.collect()}
    right = len(found & want)
    assert right / len(want) > 0.95 and right / len(found) > 0.95, (sorted(want - found)[:10], sorted(found - want)[:10])
    texts = {r["rec_id"]: r["text"] for r in redacted(df, spans).collect()}
    assert len(texts) == 703 and texts[9000] is None and texts[9001] == ""
    one = next(x for x in found if x[4] == "email")
    assert "[EMAIL]" in texts[one[1]] and data[one[1]][2][one[2] : one[3]] not in texts[one[1]]


def test_every_kind_is_found(spark, corpus):
    data, want = corpus
    found = {tuple(r) for r in personal_spans(spark.createDataFrame(data, SCHEMA)).collect()}
    for kind in POOL:
        mine = {w for w in want if w[4] == kind}
        assert len(mine & found) / len(mine) > 0.95, (kind, sorted(mine - found)[:10])


STRANGERS = ["Oleksandr Kovalenko", "Siobhan Gallagher", "Wei Zhang", "Bartholomew Quince", "Ravi Shankar", "Elizabeth Turner", "Ahmed Barzani"]
MET = ["My manager is {}.", "Ask {} about the depot.", "Please copy {} on it.", "Contact {} before noon.", "I met {} in the lane.", "Dr. {} moved the appointment."]
PLACES_AND_FIRMS = ["We met Monday at the depot.", "The Padra Mini is from Alpha Works.", "I prefer Harrow Freight, as always.", "Tell the caterer. Alpha Works called.", "The owner is away and Alpha Works is closed.", "Harrow Freight is late.", "Copy the list to Harrow Freight."]


def test_names_off_the_list_are_found_where_they_are_introduced(spark):
    said, want = [], set()
    for i, name in enumerate(STRANGERS):
        for j, form in enumerate(MET):
            start = form.index("{}")
            want.add(("s", len(said), start, start + len(name), "person"))
            said.append(form.format(name) + f" Line {i}{j}.")
    said += [t for t in PLACES_AND_FIRMS for _ in range(6)]
    df = spark.createDataFrame([("s", i, t, "") for i, t in enumerate(said)], SCHEMA)
    found = {tuple(r) for r in personal_spans(df).collect()}
    assert found == want


def test_the_gazetteer_is_an_argument(spark):
    df = spark.createDataFrame([("s", i, f"{n} Tarvelo paid. The bill of {n} is closed. So {n} Ramisko said, and {n} Tarvelo too.", "") for i, n in enumerate(["Ximena", "Anna"] * 20)], SCHEMA)
    names = lambda **kw: {r["rec_id"] % 2 for r in personal_spans(df, **kw).collect()}
    assert names() == {1} and names(gazetteer=("Ximena",)) == {0} and names(gazetteer=()) == set()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert personal_spans(df).collect() == [] and redacted(df, personal_spans(df)).collect() == []


def test_reliable_labelers_outweigh_random_ones():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = 1 if rng.random() < 0.4 else -1
        votes = [truth if rng.random() < 0.95 else -truth, truth if rng.random() < 0.9 else -truth, rng.choice([1, -1]), rng.choice([0, truth])]
        key = "k:" + ",".join(map(str, votes))
        counts[key] = counts.get(key, 0) + 1
    belief = reliabilities(counts)
    assert belief["k:1,1,-1,1"] > 0.9 > 0.1 > belief["k:-1,-1,1,-1"]
