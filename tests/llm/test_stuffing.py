"""Problem 8: pages of repeated keywords, links and product tags."""

import __spark_entry__ as driver
from rillstat.llm.stuffing import CUTOFF, SHARE, distances, features, measure

SENTENCES = "The magistrates declined to discuss the tramway in spite of the heavy rain. The choir has again complained of the new organ at the house of the widow. "
LINKS = "p. 40: http://www.morley-shop.example/ad/17\nGasthof fenlow.boots.localhost/a?id=3\n<a href=\"//tarby.tea.test/p_5\">soap</a>\n"
CASES = {
    "list": "tea, soap, boots, tea, lamp oil, soap, tea, boots, soap, tea, lamp oil, boots, " * 4,
    "pairs": "best corsets best corsets Norford improved starch improved starch Pelby cheap tramway cheap tramway " * 3,
    "numbered": "tickets warranted, tickets No. 2, new\nbargains new, bargains A502, best\ncoal genuine, coal A73, finest\n" * 4,
    "sentences": "Buy tickets cheap, tickets and portraits! No tickets like best tickets? Portraits is the finest portraits for portraits. " * 5,
    "tags": "#tea #soap @boots\n#lace #tea @soap\n" * 6,
    "links": LINKS * 5,
    "placed": "popular stoves Merrow. genuine stoves Selford, warranted stoves Merford, best starch Garrow, wholesale starch Rudgate, genuine starch Oldhurst, cheap balsam Stanton, celebrated balsam Merwick, warranted balsam Bramlet, best tonic Dungate, free tonic Garner, finest tonic Zelrick",
    "disguised": "h0t3l HOTEL h o t e l l0tt3ry LOTTERY l o t t e r y d3ntist DENTIST h0t3l HOTEL d e n t i s t l0tt3ry LOTTERY h o t e l d3ntist DENTIST l o t t e r y h0t3l HOTEL",
}
SOUND = {
    "article": SENTENCES * 4,
    "article with links": SENTENCES * 6 + LINKS,
    "names": "".join(f"Hal{c}ick, Thor{c}am, carter, {20 + i} years.\n" for i, c in enumerate("bdfghklmnprstvw")),
    "prices": "Peas, per qr. 94s. 8d. to 23s. 7d.\nMalt, per qr. 12s. 1d. to 15s. 9d.\n" * 6,
    "adverts": "WANTED, a steady girl for plain cooking. Apply Morlet, Fenby.\nLOST, near Ruddle, a brown retriever. Reward.\n" * 5,
    "unreadable": "j!«11■1i_-jj.j ^»¦ «j*■ I•;Ij,«•j _,  » | :j|_»-;¦ »^,» ^i •-«j«•j•.1■l~~*^;~•■^",
    "ages in mixed columns": "carter, 63 years.\nyears.\nyears.\n68 years.\nLangner, Oldfield, carter, 22\nPelwick, Zelrick, carter, 88\nHoxmond, Yarwell, carter, 49\nSelwick, Oldcombe, carter, 88\nyears.\nyears.\nyears.\nQuendle, Langcom, carter, 31\n",
    "arrivals": "Entré : Langlow, capitaine\nEntré : Pelner, capitaine\nThorwick, venant de Wynhurst.\nEntré : Ashham, capitaine\nEntré : Thorthorpe, capitaine\nMorby, venant de Tarby.\nLangrick, venant de Zelrow.\n" * 2,
    "links in noise": "«1-«l!  « ._i|•;j:  »*!l,■«¦i-•j«-»».:l-\nj «i.*•¦^l //^;!|~,^ l|j~•|i,«¦i• ,//l»jI|»\n",
    "empty": "",
    "blank": " \n\t ",
    "null": None,
}


def test_share_of_characters():
    assert {k: measure(v)[1] > SHARE for k, v in CASES.items()} == dict.fromkeys(CASES, True)
    assert {k: measure(v)[1] > SHARE for k, v in SOUND.items()} == dict.fromkeys(SOUND, False)


def test_very_long_text_and_empty_table(spark, tmp_path):
    assert measure(SENTENCES * 5000)[1] < 0.01 and measure("tea soap boots lace " * 50_000)[1] > 0.99
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert driver.queries()["p8_found"](spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, SENTENCES, 1.0, "x"), (3, CASES["list"], 2.0, "y"), (3, None, None, None)], "doc_id long, text string, density double, language string")
    rows = features(df).collect()
    assert sorted((r.doc_id or 0, r.language, r.density > SHARE) for r in rows) == [(0, "en", False), (3, "en", True), (3, "none", False)]


def test_direction(spark):
    docs = [(i, v) for i, v in enumerate(list(SOUND.values()) * 4)] + [(1000 + i, v) for i, v in enumerate(CASES.values())]
    rows = distances(features(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert all(r.direction > 0 and r.distance > CUTOFF for r in rows if r.doc_id >= 1000)


def test_query_names_the_cases(spark, tmp_path):
    sound = [(i, v) for i, v in enumerate(list(SOUND.values()) * 4)]
    cases = [(1000 + i, v) for i, v in enumerate(CASES.values())]
    spark.createDataFrame(sound + cases, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in driver.queries()["p8_found"](spark, str(tmp_path)).collect()) == [i for i, _ in cases]
