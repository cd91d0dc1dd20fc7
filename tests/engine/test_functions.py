import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabulon.plans.formula import FormulaError, calculate, capabilities, evaluate, parse

# Formula and value, from the documented meaning of the functions.
NUMBERS = {
    "ROUND(1.005,2)": 1.0, "ROUND(2.5,0)": 3, "MOD(7,-3)": -2, "MOD(-7,3)": 2, "CEILING(2.5,1)": 3, "FLOOR(-2.5,-2)": -2, "CEILING.MATH(-5.5,2,TRUE)": -6, "EVEN(-1)": -2, "ODD(0)": 1,
    "FACTDOUBLE(7)": 105, "PERMUT(100,3)": 970200, "COMBIN(8,2)": 28, "COMBINA(4,3)": 20, "MULTINOMIAL(2,3,4)": 1260, "GCD(24,36)": 12, "LCM(24,36)": 72, "SERIESSUM(2,0,1,{1,1,1})": 7,
    "BIN2DEC(\"1111111111\")": -1, "HEX2DEC(\"FFFFFFFF5B\")": -165, "OCT2DEC(\"7777777533\")": -165, "BITLSHIFT(4,2)": 16, "BITRSHIFT(13,2)": 3, "DECIMAL(\"zap\",36)": 45745,
    "ATAN2(1,1)": math.pi / 4, "ACOT(2)": 0.46364760900081, "ERF(0.745)": 0.707928920, "ERFC(1)": 0.157299207, "GAMMA(2.5)": 1.329340388, "GAMMALN(4)": 1.791759469,
    "NORM.DIST(42,40,1.5,TRUE)": 0.908788780, "NORM.S.DIST(1.333333,TRUE)": 0.908788726, "T.DIST.2T(1.959999998,60)": 0.054644930, "T.INV.2T(0.546449,60)": 0.606533, "T.INV(0.75,2)": 0.816496581, "F.DIST.RT(15.20686486,6,4)": 0.01, "F.INV.RT(0.01,6,4)": 15.20686486, "F.DIST(15.20686486,6,4,TRUE)": 0.99,
    "BETA.DIST(2,8,10,TRUE,1,3)": 0.685470581, "BETA.INV(0.685470581,8,10,1,3)": 2.0, "GAMMA.DIST(10.00001131,9,2,TRUE)": 0.068094004, "GAMMA.INV(0.068094,9,2)": 10.0000112, "BINOM.DIST(6,10,0.5,FALSE)": 0.205078125, "BINOM.DIST.RANGE(60,0.75,45,50)": 0.523629793, "BINOM.INV(6,0.5,0.75)": 4, "HYPGEOM.DIST(1,4,8,20,TRUE)": 0.465428277, "NEGBINOM.DIST(10,5,0.25,TRUE)": 0.313514058, "POISSON.DIST(2,5,TRUE)": 0.124652019, "EXPON.DIST(0.2,10,TRUE)": 0.864664717,
    "BESSELI(1.5,1)": 0.981666428, "BESSELJ(1.9,2)": 0.329925829, "BESSELK(1.5,1)": 0.277387800, "BESSELY(2.5,1)": 0.145918138,
    "PMT(0.08/12,10,10000)": -1037.03208936, "FV(0.06/12,10,-200,-500,1)": 2581.403374, "PV(0.08/12,240,500,0)": -59777.1458511, "NPER(0.01,-100,-1000,10000,1)": 59.6738657, "RATE(48,-200,8000)": 0.007701472, "IPMT(0.1/12,1,36,8000)": -66.6666667, "PPMT(0.1/12,1,24,2000)": -75.62318601, "SYD(30000,7500,10,1)": 4090.909091, "DB(1000000,100000,6,1,7)": 186083.333333, "EFFECT(0.0525,4)": 0.053542667, "NOMINAL(0.053543,4)": 0.052500319, "NPV(0.1,-10000,3000,4200,6800)": 1188.443412, "IRR({-70000,12000,15000,18000,21000,26000})": 0.086630948, "MIRR({-120000,39000,30000,21000,37000,46000},0.1,0.12)": 0.126094131, "DOLLARDE(1.02,16)": 1.125, "DOLLARFR(1.125,16)": 1.02, "FVSCHEDULE(1,{0.09,0.11,0.1})": 1.33089,
    "PRICE(\"2008-02-15\",\"2017-11-15\",0.0575,0.065,100,2,0)": 94.63436162, "YIELD(\"2008-02-15\",\"2016-11-15\",0.0575,95.04287,100,2,0)": 0.065000007, "DURATION(\"2008-01-01\",\"2016-01-01\",0.08,0.09,2,1)": 5.99377496, "MDURATION(\"2008-01-01\",\"2016-01-01\",0.08,0.09,2,1)": 5.73566981, "COUPNUM(\"2007-01-25\",\"2008-11-15\",2,1)": 4, "COUPDAYBS(\"2011-01-25\",\"2011-11-15\",2,1)": 71, "COUPDAYS(\"2011-01-25\",\"2011-11-15\",2,1)": 181, "COUPDAYSNC(\"2011-01-25\",\"2011-11-15\",2,1)": 110, "DISC(\"2018-07-01\",\"2048-01-01\",97.975,100,1)": 0.000686384, "TBILLPRICE(\"2008-03-31\",\"2008-06-01\",0.09)": 98.45, "TBILLYIELD(\"2008-03-31\",\"2008-06-01\",98.45)": 0.091416963, "TBILLEQ(\"2008-03-31\",\"2008-06-01\",0.0914)": 0.094151494, "PRICEDISC(\"2008-02-16\",\"2008-03-01\",0.0525,100,2)": 99.79583333, "RECEIVED(\"2008-02-15\",\"2008-05-15\",1000000,0.0575,2)": 1014584.654, "PRICEMAT(\"2008-02-15\",\"2008-04-13\",\"2007-11-11\",0.061,0.061,0)": 99.98449888, "ACCRINTM(\"2008-04-01\",\"2008-06-15\",0.1,1000,3)": 20.54794521, "ACCRINT(\"2008-03-01\",\"2008-08-31\",\"2008-05-01\",0.1,1000,2,0)": 16.666667, "ODDFPRICE(\"2008-11-11\",\"2021-03-01\",\"2008-10-15\",\"2009-03-01\",0.0785,0.0625,100,2,1)": 113.5977175, "ODDLPRICE(\"2008-02-07\",\"2008-06-15\",\"2007-10-15\",0.0375,0.0405,100,2,0)": 99.87828601, "ODDLYIELD(\"2008-04-20\",\"2008-06-15\",\"2007-12-24\",0.0375,99.875,100,2,0)": 0.045192229,
    "YEARFRAC(\"2012-01-01\",\"2012-07-30\")": 0.580555556, "YEARFRAC(\"2012-01-01\",\"2012-07-30\",1)": 0.576502732, "DAYS360(\"2011-01-30\",\"2011-02-01\")": 1, "NETWORKDAYS(\"2012-10-01\",\"2013-03-01\")": 110, "WORKDAY(\"2008-10-01\",151)": 39933, "WEEKNUM(\"2012-03-09\")": 10, "WEEKDAY(\"2008-02-14\")": 5, "DATEDIF(\"2001-06-01\",\"2002-08-15\",\"YD\")": 75, "DATE(2008,14,2)": 39846, "TIME(12,0,0)": 0.5, "HOUR(0.75)": 18, "MINUTE(0.53125)": 45, "TIMEVALUE(\"02:24\")": 0.1,
    "CONVERT(1,\"lbm\",\"kg\")": 0.45359237, "CONVERT(68,\"F\",\"C\")": 20, "IMABS(\"5+12i\")": 13, "IMARGUMENT(\"3+4i\")": 0.92729522, "VALUE(\"$1,000\")": 1000, "VALUE(\"(12%)\")": -0.12, "ARABIC(\"mcmxii\")": 1912, "UNICODE(\"B\")": 66, "-2^2": 4, "10%": 0.1, "1+2*3": 7, "2^3^2": 64,
}
TEXTS = {
    'ROMAN(499,0)': "CDXCIX", 'ROMAN(499,4)': "ID", 'ROMAN(1999)': "MCMXCIX", 'DEC2BIN(-100)': "1110011100", 'DEC2HEX(100,4)': "0064", 'BASE(7,2,8)': "00000111", 'PROPER("2-cent\'s worth")': "2-Cent'S Worth", 'SUBSTITUTE("Quarter 1, 2011","1","2",3)': "Quarter 1, 2012",
    'TEXTBEFORE("Red riding hood","hood")': "Red riding ", 'TEXTAFTER("a-b-c","-",-1)': "c", 'TEXTJOIN(", ",TRUE,"a","","b")': "a, b", 'DOLLAR(1234.567,2)': "$1,234.57", 'DOLLAR(-1234.567,1)': "($1,234.6)", 'TEXT(1234.567,"#,##0.00")': "1,234.57", 'TEXT(0.285,"0.0%")': "28.5%", 'CHAR(128)': "€", 'UNICHAR(960)': "π", 'REGEXREPLACE("a1b2","[0-9]","#",2)': "a1b#", 'IMPRODUCT("3+4i","5-3i")': "27+11i", 'IMSUB("13+4i","5+3i")': "8+i", 'IMDIV("-238+240i","10+24i")': "5+12i", 'IMCONJUGATE("3+4i")': "3-4i", 'COMPLEX(0,1,"j")': "j", 'ADDRESS(2,3)': "$C$2", 'ADDRESS(2,703,4)': "AAA2", 'IF(2>1,"y","n")': "y", '"a"&1&TRUE': "a1.0true",
}
BLANKS = ["SQRT(-1)", "LN(0)", "1/0", "0^0", "ACOS(2)", "MOD(1,0)", "FIND(\"z\",\"abc\")", "DEC2BIN(512)", "CONVERT(1,\"m\",\"g\")", "FACT(-1)", "ROMAN(4000)", "IRR({1,2})", "TEXTBEFORE(\"a\",\"-\")", "BITAND(-1,1)", "COMBIN(2,3)", "#N/A"]


def values(spark, texts):
    return spark.range(1).select(*[__import__("tabulon.plans.formula", fromlist=["lower"]).lower(parse(t), spark.range(1)).alias(f"c{i}") for i, t in enumerate(texts)]).first()


def test_numbers(spark):
    got = values(spark, NUMBERS)
    bad = {t: (g, w) for (t, w), g in zip(NUMBERS.items(), got, strict=True) if g is None or abs(float(g) - w) > 1e-6 * max(1, abs(w))}
    assert not bad


def test_texts(spark):
    got = values(spark, TEXTS)
    bad = {t: (g, w) for (t, w), g in zip(TEXTS.items(), got, strict=True) if g != w}
    assert not bad


def test_errors_are_blank(spark):
    got = values(spark, BLANKS)
    assert {t: g for t, g in zip(BLANKS, got, strict=True) if g is not None} == {}


def test_formulas_use_each_other_and_cycles_are_found(spark):
    df = spark.createDataFrame([(1, 10.0, "x"), (2, None, "Y")], "id long, a double, t string")
    out = calculate(df, {"c": "=[@b]+5", "b": "=[@a]*2", "d": '=IF([@t]="X","hit","no")'}).orderBy("id").collect()
    assert [(r["b"], r["c"], r["d"]) for r in out] == [(20.0, 25.0, "hit"), (0.0, 5.0, "no")]  # a blank number is 0
    with pytest.raises(FormulaError):
        calculate(df, {"x": "=[@y]", "y": "=[@x]"})
    with pytest.raises(FormulaError):
        calculate(df, {"x": "=NOSUCH(1)"})


def test_evaluate_conditional_aggregates(spark):
    df = spark.createDataFrame([(1.0, 10.0, "ab"), (2.0, 20.0, "AC"), (3.0, 30.0, None)], "a double, b double, t string")
    r = evaluate(df, {"s": '=SUMIF([a],">1",[b])', "c": '=COUNTIF([t],"a*")', "n": '=COUNTIF([t],"<>ab")', "blank": '=COUNTIF([t],"")'}).first()
    assert (r["s"], r["c"], r["n"], r["blank"]) == (50.0, 2, 2, 1)




def test_capability_scan(spark):
    got = capabilities(["=SUM([a])", "=NOSUCH(1)", "=1+"])
    assert [s for _, s, _ in got] == ["supported", "unsupported", "syntax"]


def test_aggregates_with_blanks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (None, 1.0), (4.0, 7.9)], "x double, y double")
    r = df.agg(F.expr("1").alias("one"), *[__import__("tabulon.functions.registry", fromlist=["function"]).function(n)(F.col("y"), F.col("x")).alias(n) for n in ("SLOPE", "CORREL", "LINEST")]).first()
    assert abs(r["LINEST"][0] - r["SLOPE"]) < 1e-9 and r["CORREL"] > 0.99


def test_xirr(spark):
    from tabulon.functions.registry import function

    rows = [([-10000.0, 2750.0, 4250.0, 3250.0, 2750.0], [dt.date(2008, 1, 1), dt.date(2008, 3, 1), dt.date(2008, 10, 30), dt.date(2009, 2, 15), dt.date(2009, 4, 1)])]
    df = spark.createDataFrame(rows, "v array<double>, d array<date>")
    assert abs(df.select(function("XIRR")(F.col("v"), F.col("d")).alias("x")).first()[0] - 0.373362535) < 1e-6


def test_what_is_not_done_is_not_registered(spark):
    from tabulon.functions.registry import catalog, function

    names = {r["name"] for r in catalog(spark).collect()}
    for name in ("FORMULATEXT", "INDIRECT", "SHEET"):
        assert name not in names
        with pytest.raises(KeyError):
            function(name)


def test_errors_are_told_from_blanks_and_go_on_to_formulas_that_use_them(spark):
    df = spark.createDataFrame([(1, 6.0, 2.0, "x"), (2, 6.0, 0.0, None), (3, None, 3.0, "4")], "id long, a double, b double, t string")
    formulas = {"q": "[@a]/[@b]", "r": "[@q]+1", "back": "IFERROR([@r],-1)", "kind": "IFERROR(ERROR.TYPE([@r]),0)", "blank": "ISBLANK([@a])", "text": "[@t]*2", "na": "IFNA(IF([@b]=0,NA(),[@a]),9)", "root": "SQRT(-1-[@b])", "missing": "ISERR(NA())"}
    rows = calculate(df, formulas, errors=True).orderBy("id").collect()
    assert [(r["q"], r["r"], r["back"], r["kind"]) for r in rows] == [(3.0, 4.0, 4.0, 0.0), (None, None, -1.0, 2.0), (0.0, 1.0, 1.0, 0.0)]
    assert [r["q!error"] for r in rows] == [None, "#DIV/0!", None] == [r["r!error"] for r in rows]
    assert [r["blank"] for r in rows] == [False, False, True] and [r["text"] for r in rows] == [None, 0.0, 8.0]
    assert [r["text!error"] for r in rows] == ["#VALUE!", None, None] and {r["root!error"] for r in rows} == {"#NUM!"}
    assert [r["na"] for r in rows] == [6.0, 9.0, None] and not any(r["missing"] for r in rows)
    assert "q!error" not in calculate(df, formulas).columns
