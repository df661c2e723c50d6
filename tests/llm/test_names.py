import pytest

from sheaf.llm import names
from tests.llm.test_edges import SCHEMAS


def pairs(spark, lists, orcids=None):
    rows = [(i, None, f"Title number {'abcdefghij'[i]}", a, 2020, None, None, None, None, (orcids or {}).get(i), None, None, None, None, None) for i, a in enumerate(lists)]
    return {(r.name_a, r.name_b) for r in names.found(spark.createDataFrame(rows, SCHEMAS["citation_records"])).collect()}


def linked(spark, *strings, lists=()):
    got = pairs(spark, [list(strings), *map(list, lists)])
    return len(got) == len(strings) * (len(strings) - 1) // 2


@pytest.mark.parametrize(
    "a, b",
    [
        ("Totajeski, Susannah", "Susannah Totajeski"), ("Totajeski, Susannah", "TOTAJESKI, S."), ("Totajeski, Susannah", "Totajeski,  Sue"), ("Totajeski, Susannah", "Susannah L. Totajeski"),
        ("Totajeski, Susannah", "Tootajeski, Susannah"), ("Totajeski, Susannah", "Totajeski Susannah"), ("Müller, Jürgen", "Muller, Juergen"), ("Zisobasen, Mei Ling", "Zisobasen ML"), ("Kerot, Christopher, Jr.", "Kerot, Christopher"),
        ("Sepipaberg Harbour Working Group", "The Sepipaberg Harbour WG"), ("Institute of Bogo Corpus", "Bogo Corpus Institute (BCI)"), ("Jarika-Jariar, Leonardo", "Leo Jarika"),
    ],
)
def test_spellings(spark, a, b):
    # a second author settles which token is the family
    extra = [["Totajeski, Viggo", "Sofa, Susannah", "Sofa, Jürgen", "Jarika-Jariar, Leonardo"]]
    assert (min(a, b), max(a, b)) in pairs(spark, [[a, b], *extra])


@pytest.mark.parametrize("a, b", [("Marx, Anna", "Marx, Anne"), ("Marx, Oscar", "Marx, Oskar"), ("Marx, Rosa", "Berg, Rosa"), ("Marx, Rosa", "Marx, Kwame"), ("Alpha Working Group", "Beta Working Group")])
def test_different_people(spark, a, b):
    assert pairs(spark, [[a, b]]) == set()


def test_an_initial_goes_to_the_author_it_shares_papers_with(spark):
    rows = [(0, None, "One thing", ["Marx, Maria"]), (1, None, "One thing", ["Marx, M."]), (2, None, "Another", ["Marx, Marco"])]
    df = spark.createDataFrame([(i, d, t, a, 2020, *[None] * 10) for i, d, t, a in rows], SCHEMAS["citation_records"])
    assert [(r.name_a, r.name_b) for r in names.found(df).collect()] == [("Marx, M.", "Marx, Maria")]


def test_an_ambiguous_initial_stays_alone(spark):
    assert pairs(spark, [["Marx, Maria"], ["Marx, Marco"], ["Marx, M."]]) == set()


def test_the_ratio_is_that_of_one_slip():
    ok = [("john", "jonh"), ("mara", "maara"), ("satelidez", "sateldez"), ("pokinedez", "pokinedze")]
    assert all(names.linked(a, b) and names.linked(b, a) for a, b in ok)
    assert not any(names.linked(a, b) for a, b in [("marx", "mars"), ("anna", "anne"), ("oscar", "oskar"), ("abcd", "dcba"), ("a1b2", "a1b")])


def test_refined_blocks_are_bounded(spark):
    import itertools

    crowd = ["".join(x) + "berg" for x in itertools.product("bcdf", "aeio", "bcdf", "aeio")]
    df = spark.createDataFrame([("r", w, 1, 5) for w in crowd], "role string, token string, n long, ratio int")
    sizes = [r["count"] for r in names.blocks(df).groupBy("role", "key").count().collect()]
    assert max(sizes) <= names.COMMON


def test_slips_against_brute_force(spark):
    import random

    random.seed(5)
    words = {"".join(random.choice("abde") for _ in range(random.randint(4, 9))): random.randint(1, 9) for _ in range(150)}
    df = spark.createDataFrame([("r", w, n, 1) for w, n in words.items()], "role string, token string, n long, ratio int")
    got = {r.token for r in names.slips(df).collect()}
    want = {a for a, n in words.items() for b, m in words.items() if (m > n or m == n and b < a) and names.linked(a, b)}
    assert got == want


def test_slips_of_long_tokens_in_crowded_blocks(spark):
    import itertools

    crowd = ["sate" + "".join(x) + "mun" for x in itertools.product("bcfghjkmnp", "ou", "bcfghjkmnp")]
    slips = {"sateldez": "satelidez", "satelizapemko": "satelizapemiko", "satelovapnik": "satelovapink", "satelunnapoo": "satelunnapo"}
    df = spark.createDataFrame([("r", w, 1, 5) for w in [*crowd, *slips]] + [("r", w, 9, 5) for w in slips.values()], "role string, token string, n long, ratio int")
    assert {r.token: r.canon for r in names.slips(df).collect()} == slips
