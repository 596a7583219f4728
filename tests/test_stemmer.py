"""Stems against the published sample vocabulary and hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from sessionscope.functions.scalars import query_tokens
from sessionscope.functions.stemmer import english_stem, stemmed
from sessionscope.operators.enrich import with_query_tokens
from sessionscope.operators.filters import text_filter

# word stem, in pairs
CASES = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consoling consol consols consol consonant conson consort consort conspicuous conspicu
conspiracy conspiraci conspirator conspir conspire conspir constable constabl constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead
kneading knead knee knee kneel kneel kneeled kneel kneels kneel knees knee knell knell knew knew knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knock knock
knocked knock knocker knocker knocking knock knocks knock knopp knopp knot knot knots knot
sky sky skies sky dying die lying lie ugly ugli early earli only onli news news atlas atlas bias bias
caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi abacus abacus
agreed agre feed feed plastered plaster bled bled motoring motor sing sing hopping hop hoping hope filing file
luxuriated luxuri conflated conflat troubled troubl sized size fizzed fizz failing fail bed bed
happy happi by by say say cry cri enjoy enjoy youth youth boyish boyish
relational relat conditional condit rational ration valenci valenc digitizer digit operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl
triplicate triplic formative format formalize formal electricity electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controlling control roll roll
generate generat generation generat generously generous general general communication communic community communiti arsenal arsenal
inning inning innings inning succeed succeed exceeding exceed proceeds proceed geology geolog
biology biolog quickly quick wholly wholli truly truli possibly possibl
purchase purchas purchases purchas purchasing purchas limits limit selected select indexes index indices indic
a a is is us us x1 x1 2024 2024 naïve naïv
""".split()


def test_vocabulary(spark):
    pairs = list(zip(CASES[::2], CASES[1::2]))
    rows = spark.createDataFrame(pairs, "word string, stem string")
    wrong = rows.withColumn("found", english_stem(F.col("word"))).filter("found <> stem").collect()
    assert wrong == []
    assert len(pairs) > 150


def test_a_stem_of_nothing(spark):
    rows = spark.createDataFrame([("",), (None,), ("yyy",), ("sss",), ("e" * 500,)], "word string")
    assert [row[0] for row in rows.select(english_stem(F.col("word"))).collect()][:2] == ["", None]


def test_joined_back(spark):
    rows = spark.createDataFrame(
        [(1, "SELECT purchases FROM ordering"), (2, None), (3, ""), (4, "the of"), (5, "ordered PURCHASE purchasing"), (1, "SELECT purchases FROM ordering")],
        "pid long, query string",
    )
    found = sorted((row.pid, row.dquery) for row in stemmed(rows, "query", query_tokens, "dquery").collect())
    assert found == [(1, ["order", "purchas", "select"])] * 2 + [(2, None), (3, []), (4, []), (5, ["order", "purchas"])]
    hits = text_filter(with_query_tokens(rows, stem=True), ["purchased"], stem=True).collect()
    assert sorted(row.pid for row in hits) == [1, 1, 5]


@pytest.mark.parametrize("words, pids", [(["orders", "purchases"], [1, 5]), (["selecting"], [1])])
def test_search_by_any_form(spark, words, pids):
    rows = spark.createDataFrame([(1, "select purchase order"), (5, "ordering purchases"), (6, "limit")], "pid long, query string")
    assert sorted(row.pid for row in text_filter(rows, words, stem=True).collect()) == pids
