import random

import pytest

from feedloom.llm import pii

KEY = b"test key"


def kinds(text):
    return [k for k, _, _ in pii.find_items(text)]


@pytest.mark.parametrize("text,want", [
    ("Reach me at hiro+field@x.example.", ["email"]), ("maren+field [at] kontor [dot] example. Two of us", ["email"]), ("kofi(at)obrador.example.\nTo be fair", ["email"]), ("Ping @dispatch or @frontdesk.", []),
    ("call +44 (0)20 7946 0144 ext. 12.", ["phone"]), ("07700 900 686", ["phone"]), ("(212) 555-0176", ["phone"]), ("030/23125132", ["phone"]), ("001-617-555-0124", ["phone"]), ("See ticket 4155550117.", []),
    ("Either 415-555-0176 or 06 39 98 81 10 after five.", ["phone", "phone"]),
    ("SSN 134-18-8923", ["id_number"]), ("Ref 000-26-6789 on the slip", []), ("DNI 62376793-B", ["id_number"]), ("QQ 06 14 41 C", ["id_number"]), ("passport no. K1048020", ["id_number"]), ("driving licence no. R244-8482-25", ["id_number"]),
    ("IdNr. 28 467 209 393", ["id_number"]), ("personnummer 701108-9027", ["id_number"]), ("Asset B25-56588 and part X56588.", []), ("Serial 4417-42466-42466-11.", []), ("Build 4.0.10.77917 on both", []), ("Order 93053 is affected, invoice 2026/20769/13", []),
    ("Send it to Apt 22B, 107 Elmstead Terrace, Pellstead 20620.", ["address"]), ("Kupferweg 137, 79846 Valmirande", ["address"]), ("183 rue des Tilleuls-Gris, 28095 Villarreja", ["address"]), ("Calle Olmo Viejo 214, 6.º C, Aldenport", ["address"]),
    ("we are at 49 heron court now", ["address"]), ("Step 26 of the Lane View wizard.", []), ("The North Road depot has 15 vans.", []), ("Coordinates 52.6360, 13.6360.", []),
    ("My colleague Rafe O'Brannock saw it", ["name"]), ("signed: Ms. Harrowgatt", ["name"]), ("Delacroisel, Rafe saw it", ["name"]), ("Both Pavel H. Ravencotte and INGRID NAVARROLA lost it", ["name", "name"]), ("anouk brackmoor here", ["name"]),
    ("Ivo called again", []), ("Smart Queue and Harbor Board", []), ("[redacted:email] bounced", []), ("", []),
])
def test_items(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text,name", [
    ("Siobhan Murphy saw it", "Siobhan Murphy"), ("Thaddeus Whitlock called.", "Thaddeus Whitlock"), ("signed: Guillermo Ortega", "Guillermo Ortega"), ("Xiomara Delgado here, again", "Xiomara Delgado"),
    ("Oluwaseun Adeyemi reported it", "Oluwaseun Adeyemi"), ("Regards,\nWanjiru Kamau-Otieno", "Wanjiru Kamau-Otieno"), ("I spoke to Bronwen T. Llewellyn about it", "Bronwen T. Llewellyn"), ("ask for MBALI NKOSI please", "MBALI NKOSI"),
])
def test_names_of_no_list_are_found_where_the_sentence_says_so(text, name):
    assert {w.lower() for w in name.split()}.isdisjoint(pii.GIVEN)
    assert [text[s:e] for k, s, e in pii.find_items(text) if k == "name"] == [name]


@pytest.mark.parametrize("text", ["The Smart Queue saw no entry", "This is Not Working", "NAMED VIEWS NEED A DEFAULT", "Since Ruskshaw East opened", "THEY CALL IT WORSE THAN BEFORE", "I am Very Happy", "signed: 4 May", "Contact: ops_team Lead"])
def test_capitals_alone_make_no_name(text):
    assert "name" not in kinds(text)


def test_given_names_are_learned_from_the_corpus(spark):
    rng = random.Random(4)
    given = ["Siobhan", "Thaddeus", "Xiomara", "Oluwaseun", "Wanjiru", "Bronwen", "Mbali", "Ruaridh", "Nneka", "Tadhg"]
    family = [f"{a}{b}" for a in ("Mur", "Whit", "Del", "Ade", "Kam", "Llew") for b in ("phyra", "lockar", "gadon", "yemin", "auris")]
    stated = ["my colleague {} told us", "Regards,\n{}", "{} called twice", "signed: {}"]
    bare = ["the form lists {} as owner", "card of {} was kept", "we met {} there", "ticket moved over to {} then"]
    rows, want = [], {}
    for k in range(600):
        name = f"{rng.choice(given)} {rng.choice(family)}"
        t = (rng.choice(stated) if k % 3 else rng.choice(bare)).format(name.lower() if k % 9 == 0 else name)
        rows.append((f"r{k}", t, "x"))
    df = spark.createDataFrame([*rows, ("n", None, "x"), ("e", "", "x"), ("d", "the Blue Gate of Grey Hall", "x")], "rec string, text string, pii_kind string")
    known = pii.learn_given(df, "text")
    assert {g.lower() for g in given} <= known and len(known) == len(pii.GIVEN) + len(given)
    got = pii.items(df, ["rec"], "text", KEY, known).collect()
    assert {r.rec for r in got} == {r[0] for r in rows} and all(r.pii_kind == "name" and r.nth == 1 for r in got)
    assert pii.learn_given(df.limit(0), "text") == pii.GIVEN
    want = {r[1][s:e].lower(): set() for r in rows for k, s, e in pii.find_items(r[1], known)}
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.rec)
        _, s, e = pii.find_items(t, known)[0]
        want[t[s:e].lower()].add(r.pseudonym)
    assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)


def _stated_and_bare():
    """Twelve given names, each stated with three family names and met once where no sentence says that it is a name; odd rows."""
    rng = random.Random(11)
    families = ["Murphyra", "Whitlockar", "Delgadon", "Adeyemin", "Kamauris", "Llewphyra"]
    rows = []
    for g in ("Siobhan", "Thaddeus", "Xiomara", "Oluwaseun", "Wanjiru", "Bronwen", "Mbali", "Ruaridh", "Nneka", "Ægir", "Éowyn", "Maria"):
        rows += [(f"stated {g} {f}", f"my colleague {g} {f} told us") for f in rng.sample(families, 3)]
        rows.append((f"bare {g}", f"the form lists {g} {rng.choice(families)} as owner"))
    rows += [("many", "MBALI KAMAURIS and wanjiru murphyra met Delgadon, Xiomara; Mr Siobhan Whitlockar was out"), ("none", "the owner lists 3 forms"), ("null", None), ("empty", "")]
    return rows + [("again", "card of Mbali Whitlockar was kept")] * 2


def test_learned_names_beyond_the_limit_of_a_set_are_all_found(spark, monkeypatch):
    df = spark.createDataFrame(_stated_and_bare(), "rec string, text string")
    known = pii.learn_given(df, "text")
    want = sorted(map(tuple, pii.items(df, ["rec"], "text", KEY, known).collect()))
    assert len(known) == len(pii.GIVEN) + 11 and {r[0] for r in want} == {r[0] for r in _stated_and_bare()} - {"none", "null", "empty"} and sum(r[0] == "many" for r in want) == 4
    monkeypatch.setattr(pii, "SEND", 5)
    assert sorted(map(tuple, pii.items(df, ["rec"], "text", KEY, pii.learn_given(df, "text")).collect())) == want


def test_names_joined_to_the_texts_equal_a_set_of_them(spark, monkeypatch):
    df = spark.createDataFrame(_stated_and_bare(), "rec string, text string")
    known = pii.learn_given(df, "text")
    want = sorted(map(tuple, pii.items(df, ["rec"], "text", KEY, known).collect()))
    redacted = sorted(map(tuple, pii.with_redacted(df, "text", KEY, known).collect()), key=str)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 20)  # few names, but long ones
    table = pii.learn_given(df, "text")
    assert pii.GIVEN | {r.first for r in table.collect()} == known
    monkeypatch.setattr(pii, "MAP_BITS", 8)  # a map that lets nearly every word pass changes nothing
    assert sorted(map(tuple, pii.items(df, ["rec"], "text", KEY, table).collect())) == want
    assert sorted(map(tuple, pii.with_redacted(df, "text", KEY, table).collect()), key=str) == redacted


def test_the_given_names_of_a_text_suffice_for_it():
    rng = random.Random(5)
    parts = ["Ann", "ANN", "ann", "o", "O", "Bo", "İb", "ΑΣ", "ας", "é", "x", "Mr", "dr.", "H.", "Maria", "Ærø", "1", "_", "@"]
    gaps = [" ", " ", " ", ", ", "'", "’", "-", ".", ". ", "\n", ""]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(1, 14)))
        known = pii.GIVEN | {w for w in sorted(pii._looked_up(text)) if rng.random() < 0.4} | {"ann", "bo-ann", "ann'bo"}
        assert pii.find_items(text, known) == pii.find_items(text, pii.GIVEN | (known & pii._looked_up(text)))
    cut = "a" * 38  # what the forty characters before the given name hold of a longer word
    assert pii.find_items("aaaa" + cut + ", Maria saw it", pii.GIVEN | {cut}) == pii.find_items("aaaa" + cut + ", Maria saw it")


def test_check_digits_hold_again():
    rng = random.Random(9)
    assert pii.cpf_digits("529982247") == "25" and pii.nir_key("1850578006084") == "91" and pii.verhoeff_digit("236") == "3"
    for _ in range(200):
        n = f"{rng.randrange(10**9):09d}"
        value = f"{n[:3]}.{n[3:6]}.{n[6:]}-{pii.cpf_digits(n)}"
        d = "".join(c for c in pii.pseudonym("id_number", value, KEY) if c.isdigit())
        assert pii.cpf_digits(d[:9]) == d[9:]
        n = f"{rng.randrange(1, 3)}{rng.randrange(100):02d}{rng.randrange(1, 13):02d}{rng.randrange(10**8):08d}"
        value = f"{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:10]} {n[10:]} {pii.nir_key(n)}"
        d = "".join(c for c in pii.pseudonym("id_number", value, KEY) if c.isdigit())
        assert d[0] == n[0] and 1 <= int(d[3:5]) <= 12 and pii.nir_key(d[:13]) == d[13:]
        n = f"{rng.randrange(2 * 10**10, 10**11)}"
        d = pii.pseudonym("id_number", n + pii.verhoeff_digit(n), KEY)
        assert d[0] > "1" and pii.verhoeff_digit(d[:11]) == d[11]
        d = "".join(c for c in pii.pseudonym("phone", f"({rng.randrange(202, 210)}) 555-{rng.randrange(10**4):04d}", KEY) if c.isdigit())
        assert pii._north_american(d)
    assert pii.pseudonym("phone", "+1 206 555 0128", KEY).startswith("+1 ") and pii.pseudonym("phone", "+44 20 7946 0144", KEY).startswith("+44 ")


def test_what_is_part_of_another_item_does_not_count_again():
    assert kinds("mail ivo.brackmoor@kontor.example") == ["email"]


def test_redaction_leaves_the_rest_alone_and_links_equal_values():
    t = "Call 07700 900 535 now.\nOr 07700 900 535!"
    r = pii.redact(t, KEY)
    a, b = r[len("Call "):r.index(" now")], r[r.index("Or ") + 3:-1]
    assert a == b and a.startswith("[phone:0") and r.startswith("Call ") and r.endswith("!") and pii.redact("nothing here", KEY) == "nothing here"


def test_feistel_is_a_permutation_and_reversible():
    seen = {pii.feistel(KEY, "t", v, 7, 11) for v in range(77)}
    assert seen == set(range(77))
    for d in ("0", "07", "123456789", "000000000000"):
        assert pii.permute_digits(KEY, "t", pii.permute_digits(KEY, "t", d), back=True) == d


def test_pseudonyms_stay_valid():
    rng = random.Random(1)
    for _ in range(50):
        n = f"{rng.randrange(10**8):08d}"
        p = pii.pseudonym("id_number", n + "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23], KEY)
        assert p[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(p[:8]) % 23]
        s = f"{rng.randrange(10**10):010d}"
        q = pii.pseudonym("id_number", "12 345 678 " + "901", KEY)
        assert len(q) == 14 and s
    assert pii._PERSONNUMMER.fullmatch(pii.pseudonym("id_number", "701108-9027", KEY))
    assert pii._SSN.fullmatch(pii.pseudonym("id_number", "134-18-8923", KEY))


def test_frames(spark):
    df = spark.createDataFrame([("a", "x@y.example and z@y.example"), ("b", None), ("c", ""), ("d", "plain " * 50_000), ("a", "x@y.example and z@y.example")], "rec string, text string")
    got = sorted(map(tuple, pii.items(df, ["rec"], "text", KEY).drop("pseudonym").distinct().collect()))
    assert got == [("a", "email", 1), ("a", "email", 2)]
    from pyspark.sql import functions as F

    out = df.select("rec", pii.redacted(F.col("text"), KEY).alias("r")).collect()
    assert out[1].r is None and out[2].r == "" and out[3].r == "plain " * 50_000
    assert pii.items(df.limit(0), ["rec"], "text", KEY).count() == 0
