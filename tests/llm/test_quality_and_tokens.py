import random

from tarmacade.llm.quality import document_statistics, quality
from tarmacade.llm.tokens import counter, encoding, token_count

PROSE = "The rain came early and most of the drivers had chosen the wrong tyres. They lost a minute on the first stage, but the road was dry by noon."
CASES = {
    "prose": PROSE, "prose without case": PROSE.lower().replace(".", "").replace(",", ""), "prose in capitals": PROSE.upper(),
    "prose, wrapped": PROSE.replace(" most", "\nmost").replace(" They", "\nThey"), "prose, wrapped at common words": "Bring warm clothes, the wind on the ridge can be cold.\nBy the time that it was over, the best of them had to be in the\nvalley, where the helicopter waited.",
    "prose with long words": "Mekaanikot vaihtoivat vaihdelaatikon alle kahdessakymmenessä minuutissa ennen erikoiskokeen uudelleenkäynnistystä.", "prose with a heading": "Rally Velin: Old Mill\n\n" + PROSE,
    "prose as dialogue": "Ann Berg: We lost a minute there, but it could have been worse.\nBo Carl: That is true, and the road was better after that.",
    "prose, terse": "Service at Velin, hard tyres fitted. Berg out, a gearbox problem. Restart delayed 40 minutes. Road icy, grip low.",
    "list": "- Old Mill\n- High Bridge\n- Long Lane\n- Velin", "list numbered": "1. Ann Berg\n2. Bo Carl\n3. Cy Dahl", "list of names": "Ann Berg\nBo Carl\nCy Dahl\nDi Ek",
    "list inline": "Entries: Ann Berg, Bo Carl, Cy Dahl, Di Ek, Old Mill, Velin, Long Lane", "table bars": "| Pos | Driver |\n|---|---|\n| 1 | Berg |\n| 2 | Carl |",
    "table tabs": "Pos\tDriver\tTime\n1\tBerg\t2:10.3\n2\tCarl\t2:11.9", "table aligned": "Pos  Driver     Time\n1    Ann Berg   2:10.3\n2    Bo Carl    2:11.9",
    "table separated": "Pos;Driver;Time\n1;Berg;2:10.3\n2;Carl;2:11.9", "table markup": "<table><tr><td>1</td><td>Berg</td></tr>\n<tr><td>2</td><td>Carl</td></tr></table>",
    "junk log": "2025-01-02 10:11:12,345 WARN [pool-1] q.Run:12 code=0x12\n2025-01-02 10:11:13,345 INFO [pool-2] q.Run:13 code=0x13",
    "junk code": "function f(a,b){return a[1]||b;}\n<div class=\"c\"><span></span></div>", "junk repeated": "go go go go go go go go go go go go",
    "junk base64": "qRzEa9NvMl4zGyBFrTMTgLk12e/4dp3Ay3iaFLS2eKHb4eMemvrKiFG/58sPc4bq", "junk encoding": "Ã©Ã¸Ã©Ã§Ã±Ã Ã©Ã¶Ã¥Ã±", "junk symbols": "★👍$@★~§/👍💨%^=🏁🏁▲>",
    "junk labels": "‹ Back Page 1 of 3 Share Menu ≡ © all rights reserved Next › Home » Top ▲", "junk filler": "of the best of the and more of it is to be in the best of that for you and the of it is in the",
    "junk vowels": "Th rn cm rly nd mst f th drvrs hd chsn th wrng tyrs fr th frst stg", "junk sentences": "\n".join(["The road was swept before the first car came through."] * 9),
}


def test_forms():
    found = dict(zip(CASES, document_statistics(list(CASES.values()))["form"]))
    assert found == {name: name.split()[0].rstrip(",") for name in CASES}


def test_what_there_is_more_of_decides():
    table = "| 1 | Berg | Old Mill | 2:10.3 |\n" * 4
    assert list(document_statistics([table + PROSE * 3, table * 8 + PROSE])["form"]) == ["prose", "table"]


def test_statistics_of_one_text():
    s = document_statistics(["Aa bb the.\n\n- x z"]).iloc[0]
    assert (s.n_words, s.bullet_lines, s.punctuated_lines) == (5, 0.5, 0.5) and s.common_words == 0.2
    assert any(r.startswith("rule: fewer than 50") for r in s.reasons) and "list: bullet (published)" in s.reasons


def test_null_blank_long_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE * 20_000), (5, PROSE), (5, PROSE), (6, "퟿ a\r\nb\x00"), (7, "x" * 300_000)]
    found = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["form"] is found[2]["form"] is found[3]["form"] is None and found[1]["reasons"] == []
    assert found[5]["form"] == "prose" and found[7]["form"] == "junk" and found[4]["n_words"] == 29 * 20_000
    assert quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_results_do_not_depend_on_the_neighbours():
    texts = list(CASES.values())
    together = document_statistics(texts)
    alone = [document_statistics([t]).iloc[0] for t in texts]
    assert all(tuple(map(str, together.iloc[i])) == tuple(map(str, alone[i])) for i in range(len(texts)))


def test_token_counts_are_exact(spark):
    rng, exact, count = random.Random(4), encoding().encode_ordinary, counter()
    alphabet = "ab  \n\t.,'é😀1 　Ω-s't"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [*CASES.values(), " lead", "trail ", "two  blanks", "a \n b", "x" * 5000, " " * 50]
    assert [count(t) for t in texts] == [len(exact(t)) for t in texts]
    frame = spark.createDataFrame([(None,), ("",), ("a b",)], "text string")
    assert [r[0] for r in frame.select(token_count("text")).collect()] == [0, 0, 2]
