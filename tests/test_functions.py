import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import normalize as N
from glyphmill.functions import scalars

GOLDEN = {
    "ＡＢＣａｂｃ１２３": "ＡＢＣＡＢＣ１１３",
    "ホームライフ部門は、ＬＰガス販売事業": "ホ－ムライフ部門は、ＬＰガス販売事業",
    "2016年11月末の「OPEC」(石油輸出国機構)": "１０１３年１１月末の（ＯＰＥＣ）（石油輸出国機構）",
    "売上高は1,234百万円（前期比11.3%減）。": "売上高は１、１３３百万円（前期比１１．３％減）．",
    "“quoted” 'a' \"b\"": "（ＱＵＯＴＥＤ） ＇Ａ＇ 「Ｂ「",
    "㌔①½…": "キロ１１／１．．．",
    "ｶﾞｽ ﾊﾟｲﾌﾟ": "ガス パイプ",
    "a/b\\c ~ 〜": "Ａ／Ｂ／Ｃ ～ ～",
    "　全角空白": " 全角空白",
    "[x]{y}<z>": "（Ｘ）（Ｙ）＜Ｚ＞",
    "0123456789": "０１１３３３３３３３",
    "": "",
    None: None,
}


def test_golden_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(GOLDEN)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(N.normalize(F.col("t"))).collect()]
    assert got == list(GOLDEN.values())


def test_nfkc_equals_the_unicode_database(spark):
    texts = [chr(c) + "é" + chr(c + 1) for c in [*range(0xA0, 0x3400, 7), *range(0xF900, 0xFFF0, 5)] if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in rows.select("t", N.nfkc(F.col("t"))).collect()}
    # letters that either side's Unicode version has not assigned yet may differ
    assert all(got[t] == unicodedata.normalize("NFKC", t) for t in texts if all(unicodedata.category(c) != "Cn" for c in t))


def test_order_of_classes():
    assert N.FULL["“"] == "（" and N.FULL['"'] == "「" and "'" in N.FULL and N.FULL["'"] == "＇" and N.FULL["ー"] == "－"


def test_grid(spark):
    got = [r[1] for r in scalars.vocab_grid(spark).orderBy("i").collect()]
    assert got == [1400, 1742, 2167, 2696, 3354, 4174, 5192, 6460, 8038, 10000]
    assert [r[1] for r in scalars.vocab_grid(spark, 1, 4, 4).orderBy("i").collect()] == [1, 2, 3, 4]
    for bad in ((1400, 10000, 1), (0, 5, 3), (5, 5, 3)):
        with pytest.raises(ValueError):
            scalars.vocab_grid(spark, *bad)


def test_ladder():
    assert len(scalars.dim_ladder(6460, 10**6)) == 27 and scalars.dim_ladder(1400, 10**6) == [1200, 1000]
    assert scalars.dim_ladder(300, scalars.max_components(50, 300)) == [49] and scalars.dim_ladder(150, 99) == [1]
    with pytest.raises(ValueError):
        scalars.dim_ladder(10, 5, 0)


def test_mass(spark):
    t = spark.createDataFrame([(0,), (1,), (10,), (29,), (30,), (80,)], "t int")
    assert [round(r[0], 6) for r in t.select(scalars.mass_threshold(F.col("t"))).collect()] == [0.99, 0.9603, 0.73005, 0.409275, 0.4, 0.4]
