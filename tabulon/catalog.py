"""The registered queries of the engine and their SQL.

Scalar functions run over whole columns of the tables. A query's result holds its rows' key and the value, rounded
alike in both dialects where it is a floating number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import catalog_functions

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scalar functions: (function, formula over a table's columns, SQL of the same)
_ORDERS = ("orders", "o_orderkey")
_PART = ("part", "p_partkey")
_EVENTS = ("events", "event_id")
_SCALAR = [
    (_ORDERS, [
        ("ABS", "ABS([@o_totalprice]-150000)", "abs(o_totalprice-150000)"), ("INT", "INT([@o_totalprice]/7)", "floor(o_totalprice/7)"), ("SIGN", "SIGN([@o_totalprice]-150000)", "CAST(sign(o_totalprice-150000) AS DOUBLE)"),
        ("SQRT", "SQRT([@o_totalprice])", "sqrt(o_totalprice)"), ("SQRTPI", "SQRTPI([@o_totalprice])", "sqrt(o_totalprice*pi())"), ("EXP", "EXP([@o_totalprice]/100000)", "exp(o_totalprice/100000)"),
        ("LN", "LN([@o_totalprice])", "ln(o_totalprice)"), ("LOG", "LOG([@o_totalprice],2)", "ln(o_totalprice)/ln(2)"), ("LOG10", "LOG10([@o_totalprice])", "log10(o_totalprice)"),
        ("MOD", "MOD([@o_custkey],-7)", "CAST(o_custkey - (-7)*floor(o_custkey/-7.0) AS DOUBLE)"), ("QUOTIENT", "QUOTIENT([@o_custkey],7)", "CAST(o_custkey//7 AS DOUBLE)"), ("POWER", "POWER([@o_custkey],0.5)", "pow(o_custkey,0.5)"),
        ("ROUNDUP", "ROUNDUP([@o_totalprice],-2)", "ceil(o_totalprice/100)*100"), ("ROUNDDOWN", "ROUNDDOWN([@o_totalprice],-2)", "floor(o_totalprice/100)*100"), ("TRUNC", "TRUNC(-[@o_totalprice])", "ceil(-o_totalprice)"), ("ROUND", "ROUND([@o_totalprice],-2)", "floor(o_totalprice/100+0.5)*100"),
        ("MROUND", "MROUND([@o_custkey],5)", "floor(o_custkey/5.0+0.5)*5"), ("CEILING", "CEILING([@o_totalprice],250)", "ceil(o_totalprice/250)*250"), ("FLOOR", "FLOOR([@o_totalprice],250)", "floor(o_totalprice/250)*250"),
        ("CEILING.MATH", "CEILING.MATH(-[@o_totalprice],250)", "ceil(-o_totalprice/250)*250"), ("FLOOR.MATH", "FLOOR.MATH(-[@o_totalprice],250)", "floor(-o_totalprice/250)*250"), ("CEILING.PRECISE", "CEILING.PRECISE(-[@o_totalprice],-250)", "ceil(-o_totalprice/250)*250"), ("FLOOR.PRECISE", "FLOOR.PRECISE(-[@o_totalprice],-250)", "floor(-o_totalprice/250)*250"), ("ISO.CEILING", "ISO.CEILING([@o_totalprice],250)", "ceil(o_totalprice/250)*250"),
        ("EVEN", "EVEN([@o_custkey])", "CAST(ceil(o_custkey/2.0)*2 AS DOUBLE)"), ("ODD", "ODD([@o_custkey])", "CAST(CASE WHEN o_custkey=0 THEN 1 ELSE ceil((o_custkey-1)/2.0)*2+1 END AS DOUBLE)"), ("PI", "PI()*[@o_custkey]", "pi()*o_custkey"),
        ("ISEVEN", "ISEVEN([@o_custkey])", "o_custkey%2=0"), ("ISODD", "ISODD([@o_custkey])", "o_custkey%2=1"),
        ("BITAND", "BITAND([@o_custkey],12)", "CAST(o_custkey&12 AS DOUBLE)"), ("BITOR", "BITOR([@o_custkey],12)", "CAST(o_custkey|12 AS DOUBLE)"), ("BITXOR", "BITXOR([@o_custkey],12)", "CAST(xor(o_custkey,12) AS DOUBLE)"), ("BITLSHIFT", "BITLSHIFT([@o_custkey],3)", "CAST(o_custkey*8 AS DOUBLE)"), ("BITRSHIFT", "BITRSHIFT([@o_custkey],3)", "CAST(o_custkey//8 AS DOUBLE)"),
        ("DEC2HEX", "DEC2HEX([@o_custkey])", "upper(to_hex(o_custkey))"), ("DEC2BIN", "DEC2BIN(MOD([@o_custkey],512))", "to_binary(o_custkey%512)"), ("DEC2OCT", "DEC2OCT(MOD([@o_custkey],8))", "CAST(o_custkey%8 AS VARCHAR)"), ("HEX2DEC", "HEX2DEC(DEC2HEX([@o_custkey]))", "CAST(o_custkey AS DOUBLE)"), ("OCT2DEC", "OCT2DEC(DEC2OCT([@o_custkey]))", "CAST(o_custkey AS DOUBLE)"), ("BIN2DEC", "BIN2DEC(DEC2BIN(MOD([@o_custkey],512)))", "CAST(o_custkey%512 AS DOUBLE)"), ("BASE", "BASE([@o_custkey],16)", "upper(to_hex(o_custkey))"), ("DECIMAL", "DECIMAL(BASE([@o_custkey],7),7)", "CAST(o_custkey AS DOUBLE)"),
        ("DELTA", "DELTA([@o_custkey],7)", "CAST(o_custkey=7 AS DOUBLE)"), ("GESTEP", "GESTEP([@o_custkey],500)", "CAST(o_custkey>=500 AS DOUBLE)"),
        ("IF", 'IF([@o_totalprice]>150000,"high","low")', "CASE WHEN o_totalprice>150000 THEN 'high' ELSE 'low' END"), ("IFS", 'IFS([@o_totalprice]>200000,"a",[@o_totalprice]>100000,"b",TRUE,"c")', "CASE WHEN o_totalprice>200000 THEN 'a' WHEN o_totalprice>100000 THEN 'b' ELSE 'c' END"), ("SWITCH", 'SWITCH([@o_orderstatus],"f",1,"o",2,9)', "CASE lower(o_orderstatus) WHEN 'f' THEN 1.0 WHEN 'o' THEN 2.0 ELSE 9.0 END"), ("CHOOSE", 'CHOOSE(MOD([@o_custkey],3)+1,"x","y","z")', "['x','y','z'][o_custkey%3+1]"),
        ("AND", 'AND([@o_totalprice]>100000,[@o_orderstatus]="O")', "o_totalprice>100000 AND o_orderstatus='O'"), ("OR", 'OR([@o_totalprice]>100000,[@o_orderstatus]="O")', "o_totalprice>100000 OR o_orderstatus='O'"), ("XOR", 'XOR([@o_totalprice]>100000,[@o_orderstatus]="O")', "(o_totalprice>100000) <> (o_orderstatus='O')"), ("NOT", "NOT([@o_totalprice]>100000)", "NOT (o_totalprice>100000)"), ("IFERROR", "IFERROR(1/([@o_custkey]-7),-1)", "CASE WHEN o_custkey=7 THEN -1 ELSE 1.0::DOUBLE/(o_custkey-7) END"),
        ("YEAR", "YEAR([@o_orderdate])", "CAST(year(o_orderdate) AS DOUBLE)"), ("MONTH", "MONTH([@o_orderdate])", "CAST(month(o_orderdate) AS DOUBLE)"), ("DAY", "DAY([@o_orderdate])", "CAST(day(o_orderdate) AS DOUBLE)"), ("WEEKDAY", "WEEKDAY([@o_orderdate],2)", "CAST(isodow(o_orderdate) AS DOUBLE)"), ("ISOWEEKNUM", "ISOWEEKNUM([@o_orderdate])", "CAST(week(o_orderdate) AS DOUBLE)"), ("EOMONTH", "EOMONTH([@o_orderdate],1)", "CAST(last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) - DATE '1899-12-30' AS DOUBLE)"), ("EDATE", "EDATE([@o_orderdate],-2)", "CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH AS DATE) - DATE '1899-12-30' AS DOUBLE)"), ("DAYS", 'DAYS([@o_orderdate],"1995-01-01")', "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS DOUBLE)"), ("DATE", "DATE(YEAR([@o_orderdate]),MONTH([@o_orderdate])+1,0)", "CAST(last_day(CAST(o_orderdate AS DATE)) - DATE '1899-12-30' AS DOUBLE)"), ("DATEDIF", 'DATEDIF("1992-01-01",[@o_orderdate],"M")', "CAST(datesub('month', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)"),
        ("EFFECT", "EFFECT([@o_custkey]/100000+0.01,12)", "pow(1+(o_custkey/100000.0::DOUBLE+0.01)/12,12)-1"), ("NOMINAL", "NOMINAL([@o_custkey]/100000+0.01,12)", "12*(pow(1+(o_custkey/100000.0::DOUBLE+0.01),1/12.0::DOUBLE)-1)"), ("SLN", "SLN([@o_totalprice],1000,10)", "(o_totalprice-1000)/10"), ("SYD", "SYD([@o_totalprice],1000,10,3)", "(o_totalprice-1000)*8*2/110"), ("FV", "FV(0.01,12,-100,-[@o_totalprice])", "o_totalprice*pow(1.01::DOUBLE,12)+100*(pow(1.01::DOUBLE,12)-1)/0.01"), ("PV", "PV(0.01,12,0,-[@o_totalprice])", "o_totalprice/pow(1.01::DOUBLE,12)"), ("PMT", "PMT(0.01,12,[@o_totalprice])", "-o_totalprice*pow(1.01::DOUBLE,12)*0.01/(pow(1.01::DOUBLE,12)-1)"), ("RRI", "RRI(10,1000,[@o_totalprice])", "pow(o_totalprice/1000,0.1::DOUBLE)-1"), ("PDURATION", "PDURATION(0.05,1000,[@o_totalprice])", "ln(o_totalprice/1000)/ln(1.05::DOUBLE)"), ("ISPMT", "ISPMT(0.1,1,36,[@o_totalprice])", "-o_totalprice*0.1*(1-1/36.0::DOUBLE)"), ("STANDARDIZE", "STANDARDIZE([@o_totalprice],150000,77777)", "(o_totalprice-150000)/77777"), ("EXPON.DIST", "EXPON.DIST([@o_totalprice],0.00001,TRUE)", "1-exp(-0.00001::DOUBLE*o_totalprice)"), ("PHI", "PHI([@o_totalprice]/100000)", "exp(-pow(o_totalprice/100000,2)/2)/sqrt(2*pi())"),
    ]),
    (_EVENTS, [(n, f"{n}([@value]/100)", f"{sql}(value/100)") for n, sql in {"SIN": "sin", "COS": "cos", "TAN": "tan", "ATAN": "atan", "SINH": "sinh", "COSH": "cosh", "TANH": "tanh", "ASINH": "asinh", "DEGREES": "degrees", "RADIANS": "radians"}.items()]
     + [("SEC", "SEC([@value]/100)", "1/cos(value/100)"), ("SECH", "SECH([@value]/100)", "1/cosh(value/100)"), ("ACOT", "ACOT([@value]/100)", "atan2(1,value/100)"), ("ATAN2", "ATAN2([@value]+1,2)", "atan2(2,value+1)"), ("COT", "COT([@value]+1)", "cos(value+1)/sin(value+1)"), ("CSC", "CSC([@value]+1)", "1/sin(value+1)"), ("CSCH", "CSCH([@value]/100+1)", "1/sinh(value/100+1)"), ("COTH", "COTH([@value]/100+1)", "1/tanh(value/100+1)"), ("ACOSH", "ACOSH(ABS([@value])+1)", "acosh(abs(value)+1)"), ("ASIN", "ASIN(1/(ABS([@value])+1))", "asin(1/(abs(value)+1))"), ("ACOS", "ACOS(1/(ABS([@value])+1))", "acos(1/(abs(value)+1))"), ("ATANH", "ATANH(1/(ABS([@value])+2))", "atanh(1/(abs(value)+2))"), ("ACOTH", "ACOTH(ABS([@value])+2)", "0.5*ln((abs(value)+3)/(abs(value)+1))")]),
    (_PART, [
        ("LOWER", "LOWER([@p_name])", "lower(p_name)"), ("UPPER", "UPPER([@p_name])", "upper(p_name)"), ("LEN", "LEN([@p_name])", "CAST(length(p_name) AS DOUBLE)"), ("LEFT", "LEFT([@p_name],3)", "left(p_name,3)"), ("RIGHT", "RIGHT([@p_name],3)", "right(p_name,3)"), ("MID", "MID([@p_name],2,4)", "substring(p_name,2,4)"), ("CONCAT", 'CONCAT([@p_brand],"/",[@p_type])', "p_brand||'/'||p_type"), ("CONCATENATE", 'CONCATENATE([@p_brand],[@p_size])', "p_brand||p_size"), ("EXACT", 'EXACT([@p_type],UPPER([@p_type]))', "p_type=upper(p_type)"), ("FIND", 'FIND("a",[@p_name])', "nullif(CAST(instr(p_name,'a') AS DOUBLE),0)"), ("SEARCH", 'SEARCH("A",[@p_name])', "nullif(CAST(instr(lower(p_name),'a') AS DOUBLE),0)"), ("REPLACE", 'REPLACE([@p_name],2,3,"#")', "left(p_name,1)||'#'||substring(p_name,5)"), ("REPT", 'REPT("x",[@p_size])', "repeat('x',p_size)"), ("SUBSTITUTE", 'SUBSTITUTE([@p_name],"a","_")', "replace(p_name,'a','_')"), ("TRIM", 'TRIM("  "&[@p_type]&"   x ")', "trim(regexp_replace('  '||p_type||'   x ',' +',' ','g'))"), ("CLEAN", "CLEAN([@p_name])", "p_name"), ("TEXTJOIN", 'TEXTJOIN("-",TRUE,[@p_brand],"",[@p_type])', "p_brand||'-'||p_type"), ("UNICODE", "UNICODE([@p_name])", "CAST(unicode(p_name) AS DOUBLE)"), ("TEXTBEFORE", 'TEXTBEFORE([@p_brand],"#")', "CASE WHEN instr(p_brand,'#')>0 THEN split_part(p_brand,'#',1) END"), ("TEXTAFTER", 'TEXTAFTER([@p_brand],"#")', "CASE WHEN instr(p_brand,'#')>0 THEN substring(p_brand,instr(p_brand,'#')+1) END"), ("REGEXTEST", 'REGEXTEST([@p_type],"^[A-M]")', "regexp_matches(p_type,'^[A-M]')"), ("REGEXEXTRACT", 'REGEXEXTRACT([@p_brand],"[0-9]+")', "nullif(regexp_extract(p_brand,'[0-9]+'),'')"), ("VALUE", 'VALUE("$"&[@p_size]&"%")', "p_size*0.01::DOUBLE"), ("PROPER", "PROPER(LOWER([@p_brand]))", None), ("TEXT", 'TEXT([@p_retailprice],"#,##0.00")', None), ("ROMAN", "ROMAN([@p_size])", None), ("ARABIC", "ARABIC(ROMAN([@p_size]))", "CAST(p_size AS DOUBLE)"), ("FACT", "FACT(MOD([@p_size],15))", "CAST(factorial(CAST(p_size%15 AS INTEGER)) AS DOUBLE)"), ("COMBIN", "COMBIN([@p_size]+2,2)", "CAST((p_size+2)*(p_size+1)/2 AS DOUBLE)"), ("COMBINA", "COMBINA([@p_size]+1,2)", "CAST((p_size+2)*(p_size+1)/2 AS DOUBLE)"), ("GCD", "GCD([@p_size],12)", "CAST(gcd(p_size,12) AS DOUBLE)"), ("LCM", "LCM([@p_size],12)", "CAST(lcm(p_size,12) AS DOUBLE)"), ("PERMUT", "PERMUT([@p_size]+1,2)", "CAST((p_size+1)*p_size AS DOUBLE)"), ("PERMUTATIONA", "PERMUTATIONA([@p_size],2)", "CAST(p_size*p_size AS DOUBLE)"), ("ISTEXT", "ISTEXT([@p_name])", "true"), ("ISNUMBER", "ISNUMBER([@p_size])", "true"), ("ISBLANK", "ISBLANK([@p_name])", "p_name IS NULL"), ("CONVERT", 'CONVERT([@p_size],"ft","m")', "p_size*0.3048::DOUBLE"), ("COMPLEX", "IMABS(COMPLEX([@p_size],2))", "sqrt(p_size*p_size+4)"), ("IMREAL", 'IMREAL(IMPRODUCT(COMPLEX([@p_size],1),"2+3i"))', "CAST(p_size*2-3 AS DOUBLE)"), ("IMAGINARY", 'IMAGINARY(IMSUM(COMPLEX([@p_size],1),"2+3i"))', "4.0::DOUBLE"),
        ("NORM.S.DIST", "NORM.S.DIST([@p_size]/25,TRUE)", None), ("NORM.DIST", "NORM.DIST([@p_size],25,10,TRUE)", None), ("GAMMALN", "GAMMALN([@p_size]+1)", "lgamma(p_size+1)"), ("GAMMA", "GAMMA([@p_size]/10+1)", "gamma(p_size/10.0::DOUBLE+1)"), ("T.DIST.2T", "T.DIST.2T([@p_size]/10,1)", "1-2*atan(p_size/10.0::DOUBLE)/pi()"), ("POISSON.DIST", "POISSON.DIST(0,[@p_size],FALSE)", "exp(-p_size::DOUBLE)"), ("BINOM.DIST", "BINOM.DIST(1,[@p_size],0.1,FALSE)", "p_size*0.1::DOUBLE*pow(0.9::DOUBLE,p_size-1)"), ("F.DIST.RT", "F.DIST.RT([@p_size],2,2)", "1/(1+p_size::DOUBLE)"), ("BETA.DIST", "BETA.DIST([@p_size]/51,2,1,TRUE)", "pow(p_size/51.0::DOUBLE,2)"), ("GAMMA.DIST", "GAMMA.DIST([@p_size],1,10,TRUE)", "1-exp(-p_size/10.0::DOUBLE)"), ("PRICE", 'PRICE("2008-02-15",EDATE("2017-11-15",[@p_size]),0.0575,0.065,100,2)', None), ("RATE", "RATE(48,-200,8000+[@p_size])", None), ("WORKDAY", 'WORKDAY("2008-10-01",[@p_size])', None), ("NETWORKDAYS", 'NETWORKDAYS("2008-10-01",EDATE("2008-10-01",[@p_size]))', None), ("YEARFRAC", 'YEARFRAC("2008-10-01",EDATE("2008-10-01",[@p_size]),0)', "p_size/12.0::DOUBLE"),
    ]),
]


#: Functions whose results aren't numbers.
_PLAIN = set("DEC2HEX DEC2BIN DEC2OCT BASE IF IFS CHOOSE AND OR XOR NOT ISEVEN ISODD LOWER UPPER LEFT RIGHT MID CONCAT CONCATENATE EXACT REPLACE REPT SUBSTITUTE TRIM CLEAN TEXTJOIN TEXTBEFORE TEXTAFTER REGEXTEST REGEXEXTRACT ISTEXT ISNUMBER ISBLANK".split())


def _scalar(name, table, key, text, sql):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tabulon.plans.formula import calculate

        out = calculate(_table(spark, sf_dir, table), {"result": text}).select(key, "result")
        return out.withColumn("result", F.round("result", 6)) if dict(out.dtypes)["result"] == "double" else out

    _queries[f"fn_{name.lower().replace('.', '_')}"] = run
    if sql:
        _sql[f"fn_{name.lower().replace('.', '_')}"] = f"SELECT {key}, {sql if name in _PLAIN else f'round(CAST({sql} AS DOUBLE), 6)'} AS result FROM {table}"


for (_t, _k), _rows in _SCALAR:
    for _n, _f, _s in _rows:
        _scalar(_n, _t, _k, _f, _s)


def _more(rows, plain: bool) -> None:
    for name, (table, key), text, sql in rows:
        if plain:
            _PLAIN.add(name)
        _scalar(name.replace("+", "_2"), table, key, text, sql)


_more(catalog_functions.NUMBERS, False)
_more(catalog_functions.TEXTS, True)


# ---- errors and blanks: b is blank for every fifth customer, z is 0, 1 or 2
_ERRORS = {
    "ISERROR": ("ISERROR([@b]/[@z])", "z=0"), "ISERR": ("ISERR(IF([@z]=1,NA(),[@b]/[@z]))", "z=0"), "ISNA": ("ISNA(IF([@z]=1,NA(),1/[@z]))", "z=1"), "NA": ("ISNA(NA())", "true"),
    "IFNA": ("IFNA(IF([@z]=1,NA(),5),7)", "CASE WHEN z=1 THEN 7.0 ELSE 5.0 END"), "IFERROR_2": ("IFERROR([@b]/[@z],-1)", "CASE WHEN z=0 THEN -1.0 ELSE coalesce(b,0)/z END"), "ERROR.TYPE": ("IFERROR(ERROR.TYPE(1/[@z]),0)", "CASE WHEN z=0 THEN 2.0 ELSE 0.0 END"),
    "ISBLANK_2": ("ISBLANK([@b])", "b IS NULL"), "BLANK_SUM": ("[@b]+5", "CAST(coalesce(b,0)+5 AS DOUBLE)"), "BLANK_EQUAL": ("[@b]=0", "coalesce(b,0)=0"), "ERROR_CHAIN": ("IFERROR([@ratio]+1,-9)", "CASE WHEN z=0 THEN -9.0 ELSE coalesce(b,0)/z+1 END"),
}


def _error_query(name, text, sql):
    @query(f"fn_{name.lower().replace('.', '_')}", f"SELECT o_orderkey, {sql} AS result FROM (SELECT o_orderkey, CASE WHEN o_custkey%5>0 THEN (o_custkey%5)::DOUBLE END AS b, (o_custkey%3)::DOUBLE AS z FROM orders)")
    def run(spark, sf_dir):
        from tabulon.plans.formula import calculate

        orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5).cast("double").alias("b"), (F.col("o_custkey") % 3).cast("double").alias("z"))
        return calculate(orders, {"result": text, "ratio": "[@b]/[@z]"}).select("o_orderkey", "result")


for _n, (_f, _s) in _ERRORS.items():
    _error_query(_n, _f, _s)


# ---- aggregates by a formula over lineitem, grouped by return flag
_AGGREGATES = {
    "SUM": ("SUM([l_quantity])", "sum(l_quantity)"), "AVERAGE": ("AVERAGE([l_quantity])", "avg(l_quantity)"), "MIN": ("MIN([l_extendedprice])", "min(l_extendedprice)"), "MAX": ("MAX([l_extendedprice])", "max(l_extendedprice)"), "COUNT": ("COUNT([l_quantity])", "count(l_quantity)"), "COUNTA": ("COUNTA([l_linestatus])", "count(l_linestatus)"), "COUNTBLANK": ("COUNTBLANK([l_linestatus])", "count(*) FILTER (l_linestatus IS NULL OR l_linestatus='')"), "SUMSQ": ("SUMSQ([l_quantity])", "sum(l_quantity*l_quantity)"),
    "SUMPRODUCT": ("SUMPRODUCT([l_quantity],[l_discount])", "sum(l_quantity*l_discount)"), "SUBTOTAL": ("SUBTOTAL(109,[l_quantity])", "sum(l_quantity)"), "SUMIFS": ('SUMIFS([l_extendedprice],[l_linestatus],"f",[l_quantity],">=25")', "coalesce(sum(l_extendedprice) FILTER (l_linestatus='F' AND l_quantity>=25),0)"), "SUMIF": ('SUMIF([l_quantity],">=25",[l_extendedprice])', "sum(l_extendedprice) FILTER (l_quantity>=25)"), "COUNTIF": ('COUNTIF([l_linestatus],"?")', "count(*) FILTER (length(l_linestatus)=1)"), "COUNTIFS": ('COUNTIFS([l_quantity],"<>7",[l_linestatus],"o")', "count(*) FILTER (l_quantity<>7 AND l_linestatus='O')"), "AVERAGEIF": ('AVERAGEIF([l_quantity],"<10",[l_tax])', "avg(l_tax) FILTER (l_quantity<10)"), "AVERAGEIFS": ('AVERAGEIFS([l_tax],[l_quantity],"<10")', "avg(l_tax) FILTER (l_quantity<10)"), "MINIFS": ('MINIFS([l_extendedprice],[l_quantity],">40")', "coalesce(min(l_extendedprice) FILTER (l_quantity>40),0)"), "MAXIFS": ('MAXIFS([l_extendedprice],[l_quantity],"<10")', "coalesce(max(l_extendedprice) FILTER (l_quantity<10),0)"),
    "MEDIAN": ("MEDIAN([l_quantity])", "median(l_quantity)"), "STDEV.S": ("STDEV.S([l_quantity])", "stddev_samp(l_quantity)"), "STDEV.P": ("STDEV.P([l_quantity])", "stddev_pop(l_quantity)"), "VAR.S": ("VAR.S([l_quantity])", "var_samp(l_quantity)"), "VAR.P": ("VAR.P([l_quantity])", "var_pop(l_quantity)"), "DEVSQ": ("DEVSQ([l_quantity])", "var_pop(l_quantity)*count(l_quantity)"), "GEOMEAN": ("GEOMEAN([l_quantity])", "exp(avg(ln(l_quantity)))"), "HARMEAN": ("HARMEAN([l_quantity])", "count(*)/sum(1/l_quantity)"), "CORREL": ("CORREL([l_quantity],[l_extendedprice])", "corr(l_quantity,l_extendedprice)"), "RSQ": ("RSQ([l_quantity],[l_extendedprice])", "pow(corr(l_quantity,l_extendedprice),2)"), "COVARIANCE.P": ("COVARIANCE.P([l_quantity],[l_discount])", "covar_pop(l_quantity,l_discount)"), "COVARIANCE.S": ("COVARIANCE.S([l_quantity],[l_discount])", "covar_samp(l_quantity,l_discount)"), "SLOPE": ("SLOPE([l_extendedprice],[l_quantity])", "regr_slope(l_extendedprice,l_quantity)"), "INTERCEPT": ("INTERCEPT([l_extendedprice],[l_quantity])", "regr_intercept(l_extendedprice,l_quantity)"), "SUMX2MY2": ("SUMX2MY2([l_quantity],[l_tax])", "sum(l_quantity*l_quantity-l_tax*l_tax)"), "SUMX2PY2": ("SUMX2PY2([l_quantity],[l_tax])", "sum(l_quantity*l_quantity+l_tax*l_tax)"), "SUMXMY2": ("SUMXMY2([l_quantity],[l_tax])", "sum(pow(l_quantity-l_tax,2))"), "PERCENTILE.INC": ("PERCENTILE.INC([l_quantity],0.9)", "quantile_cont(l_quantity,0.9)"), "QUARTILE.INC": ("QUARTILE.INC([l_quantity],3)", "quantile_cont(l_quantity,0.75)"), "PERCENTOF": ("PERCENTOF([l_discount],[l_quantity])", "sum(l_discount)/sum(l_quantity)"), "AVERAGEA": ("AVERAGEA([l_quantity])", "avg(l_quantity)"), "MAXA": ("MAXA([l_tax])", "max(l_tax)"), "MINA": ("MINA([l_tax])", "min(l_tax)"),
}


def _aggregate(name, text, sql, table="lineitem", by="l_returnflag"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tabulon.plans.formula import lower, parse

        df = _table(spark, sf_dir, table)
        return df.groupBy(by).agg(F.round(lower(parse(text), df).cast("double"), 4).alias("result"))

    own = f"agg_{name.lower().replace('.', '_').replace('+', '_several')}"
    _queries[own] = run
    if sql:
        _sql[own] = f"SELECT {by}, round(CAST({sql} AS DOUBLE), 4) AS result FROM {table} GROUP BY {by}"


for _n, (_f, _s) in _AGGREGATES.items():
    _aggregate(_n, _f, _s)
for _n, _f, _s in catalog_functions.AGGREGATES:
    _aggregate(_n, _f, _s, "customer", "c_mktsegment")


# ---- relational operators
@query("groupby_subtotals", "SELECT l_returnflag, l_linestatus, CAST(CASE WHEN grouping(l_returnflag)=1 THEN 2 WHEN grouping(l_linestatus)=1 THEN 1 ELSE 0 END AS INTEGER) AS level, round(sum(l_quantity),2) AS qty, round(avg(l_extendedprice),4) AS price, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _groupby(spark, sf_dir):
    from tabulon.operators.grouping import groupby

    return groupby(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"qty": F.round(F.sum("l_quantity"), 2), "price": F.round(F.avg("l_extendedprice"), 4), "n": F.count(F.lit(1))}, depth=2)


@query("pivotby", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus='F'),2) AS F, round(sum(l_quantity) FILTER (l_linestatus='O'),2) AS O, round(sum(l_quantity) FILTER (l_linestatus='P'),2) AS P, round(sum(l_quantity),2) AS \"Total\", CAST(grouping(l_returnflag) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _pivot(spark, sf_dir):
    from tabulon.operators.grouping import pivotby

    return pivotby(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", lambda c: F.round(F.sum(c), 2), values=["F", "O", "P"])


@query("pivotby_share_of_row", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus='F')/sum(l_quantity),8) AS F, round(sum(l_quantity) FILTER (l_linestatus='O')/sum(l_quantity),8) AS O FROM lineitem GROUP BY l_returnflag")
def _share(spark, sf_dir):
    from tabulon.operators.grouping import pivotby

    out = pivotby(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", values=["F", "O"], relative="row")
    return out.select("l_returnflag", F.round("F", 8).alias("F"), F.round("O", 8).alias("O"))


@query("xlookup_exact", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, p.p_name, p.p_retailprice FROM lineitem l LEFT JOIN part p ON p.p_partkey=l.l_partkey")
def _xlookup(spark, sf_dir):
    from tabulon.operators.lookup import xlookup

    return xlookup(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_partkey", _table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_retailprice"], "p_partkey")


@query("xlookup_next_smaller", "SELECT e.event_id, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_totalprice <= e.value*1000) AS found FROM events e")
def _next_smaller(spark, sf_dir):
    from tabulon.operators.lookup import xlookup

    probes = _table(spark, sf_dir, "events").select("event_id", (F.col("value") * 1000).alias("probe"))
    table = _table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_totalprice").alias("found"), "o_orderkey")
    return xlookup(probes, "probe", table, "o_totalprice", ["found"], "o_orderkey", match=-1).select("event_id", "found")


@query("xlookup_next_larger", "SELECT e.event_id, (SELECT min(o.o_totalprice) FROM orders o WHERE o.o_totalprice >= e.value*1000) AS found FROM events e")
def _next_larger(spark, sf_dir):
    from tabulon.operators.lookup import xlookup

    probes = _table(spark, sf_dir, "events").select("event_id", (F.col("value") * 1000).alias("probe"))
    table = _table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_totalprice").alias("found"), "o_orderkey")
    return xlookup(probes, "probe", table, "o_totalprice", ["found"], "o_orderkey", match=1).select("event_id", "found")


@query("vlookup", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON n.n_nationkey=c.c_nationkey")
def _vlookup(spark, sf_dir):
    from tabulon.operators.lookup import vlookup

    table = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("o"))
    return vlookup(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table, 2, "o", approximate=False).drop("c_nationkey")


@query("match_position", "SELECT c.c_custkey, n.place AS position FROM customer c LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS place FROM nation) n ON n.n_nationkey=c.c_nationkey")
def _match(spark, sf_dir):
    from tabulon.operators.lookup import match

    return match(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", _table(spark, sf_dir, "nation"), "n_nationkey", "n_name").drop("c_nationkey")


@query("filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice>200000 AND o_orderstatus='O'")
def _filter(spark, sf_dir):
    from tabulon.operators.arrays import filter_rows

    return filter_rows(_table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@query("sort_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _sort_take(spark, sf_dir):
    from tabulon.operators.arrays import sort_keys, take

    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return take(orders, 100, sort_keys(orders, [("o_totalprice", -1)], "o_orderkey"))


@query("drop_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)")
def _drop(spark, sf_dir):
    from tabulon.operators.arrays import drop

    return drop(_table(spark, sf_dir, "orders").select("o_orderkey"), 10, "o_orderkey")


@query("unique", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _unique(spark, sf_dir):
    from tabulon.operators.arrays import unique

    return unique(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderstatus", "o_orderpriority")


@query("unique_exactly_once", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*)=1")
def _once(spark, sf_dir):
    from tabulon.operators.arrays import unique

    return unique(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", True).select("o_custkey")


@query("vstack", "SELECT n_name AS name, n_regionkey AS k FROM nation UNION ALL SELECT r_name, NULL FROM region")
def _vstack(spark, sf_dir):
    from tabulon.operators.arrays import vstack

    return vstack(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k")), _table(spark, sf_dir, "region").select("r_name"))


@query("hstack", "SELECT coalesce(n.n_nationkey, r.r_regionkey) AS place, n_name, r_name FROM nation n FULL JOIN region r ON n.n_nationkey=r.r_regionkey")
def _hstack(spark, sf_dir):
    from tabulon.operators.arrays import hstack

    return hstack(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), "n_name"), _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("place"), "r_name"), "place")


@query("tocol", "SELECT CAST(n_nationkey AS BIGINT) AS major, CAST(i AS BIGINT) AS minor, CASE i WHEN 0 THEN n_nationkey ELSE n_regionkey END AS value FROM nation, range(2) t(i)")
def _tocol(spark, sf_dir):
    from tabulon.operators.arrays import to_column

    return to_column(_table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])


@query("wraprows", "SELECT (n_nationkey//5)+1 AS row, max(n_name) FILTER (n_nationkey%5=0) AS c1, max(n_name) FILTER (n_nationkey%5=1) AS c2, max(n_name) FILTER (n_nationkey%5=2) AS c3, max(n_name) FILTER (n_nationkey%5=3) AS c4, max(n_name) FILTER (n_nationkey%5=4) AS c5 FROM nation GROUP BY 1")
def _wrap(spark, sf_dir):
    from tabulon.operators.arrays import wrap_rows

    return wrap_rows(_table(spark, sf_dir, "nation").withColumn("place", F.col("n_nationkey") + 1), "place", "n_name", 5)


@query("sequence", "SELECT i+1 AS row, 10+i*3*0.5::DOUBLE AS c1, 10+(i*3+1)*0.5::DOUBLE AS c2, 10+(i*3+2)*0.5::DOUBLE AS c3 FROM range(1000) t(i)")
def _sequence(spark, sf_dir):
    from tabulon.operators.arrays import sequence

    return sequence(spark, 1000, 3, 10, 0.5)


@query("mmult_gram", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS k FROM embeddings) SELECT a.k AS i, b.k AS j, round(sum(a.v*b.v),3) AS v FROM c a JOIN c b USING (vec_id) GROUP BY ALL")
def _mmult(spark, sf_dir):
    from tabulon.operators.arrays import mmult, transpose

    cells = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", (F.col("j") + 1).alias("j"), F.col("v").cast("double").alias("v"))
    return mmult(transpose(cells), cells).select("i", "j", F.round("v", 3).alias("v"))


@query("scan_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),2) AS running FROM orders")
def _scan(spark, sf_dir):
    from tabulon.operators.arrays import scan

    return scan(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", ["o_custkey"]).select("o_orderkey", F.round("running", 2).alias("running"))


@query("rank_eq", "SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice DESC) AS BIGINT) AS rank FROM orders")
def _rank(spark, sf_dir):
    from tabulon.functions.registry import function

    return function("RANK.EQ")(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "rank")


@query("trend", "SELECT o_orderkey, round((SELECT regr_intercept(o_totalprice, o_custkey) FROM orders) + (SELECT regr_slope(o_totalprice, o_custkey) FROM orders) * o_custkey, 3) AS trend FROM orders")
def _trend(spark, sf_dir):
    from tabulon.functions.registry import function

    return function("TREND")(_table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"]).select("o_orderkey", F.round("trend", 3).alias("trend"))


@query("trend_origin", "SELECT c_custkey, round((SELECT sum(o_totalprice*o_custkey)/sum(CAST(o_custkey AS DOUBLE)*o_custkey) FROM orders) * c_custkey, 3) AS trend FROM customer")
def _trend_origin(spark, sf_dir):
    from tabulon.functions.registry import function

    new = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    return function("TREND")(_table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], new, const=False).select("c_custkey", F.round("trend", 3).alias("trend"))


@query("growth", "SELECT o_orderkey, round(exp((SELECT regr_intercept(ln(o_totalprice), o_custkey) FROM orders) + (SELECT regr_slope(ln(o_totalprice), o_custkey) FROM orders) * o_custkey), 3) AS growth FROM orders")
def _growth(spark, sf_dir):
    from tabulon.functions.registry import function

    return function("GROWTH")(_table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"]).select("o_orderkey", F.round("growth", 3).alias("growth"))


@query("hlookup", "WITH s AS (SELECT CAST(s_nationkey AS DOUBLE) AS a, CAST(s_acctbal AS DOUBLE) AS b, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) SELECT c_custkey, CASE WHEN k.a<=c_acctbal AND (k.b>c_acctbal OR k.a>=k.b) THEN v.a WHEN k.b<=c_acctbal THEN v.b END AS value FROM customer, s k, s v WHERE k.place=1 AND v.place=3")
def _hlookup(spark, sf_dir):
    from tabulon.functions.registry import function

    wide = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.col("s_acctbal").cast("double").alias("b"))
    probes = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("key"))
    return function("HLOOKUP")(probes, "key", wide, 3, "s_suppkey").select("c_custkey", "value")


@query("large", "SELECT (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 1 OFFSET 9) AS value")
def _large(spark, sf_dir):
    from tabulon.functions.registry import function

    return function("LARGE")(_table(spark, sf_dir, "orders"), "o_totalprice", 10)


@query("map_reduce_lambda", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)),6) AS norm2 FROM embeddings")
def _lambda(spark, sf_dir):
    from tabulon.functions.registry import function

    squares = function("MAP")(F.col("embedding"), lambda x: x.cast("double") * x.cast("double"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(function("REDUCE")(F.lit(0.0), squares, lambda a, x: a + x), 6).alias("norm2"))


@query("xlookup_wildcard", "SELECT i AS k, (SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%' || chr(97+i::INTEGER) || '%' ORDER BY lower(p_type), p_partkey LIMIT 1) AS p_partkey FROM range(26) t(i)")
def _wild(spark, sf_dir):
    from tabulon.operators.lookup import xlookup

    probes = spark.range(26).select(F.col("id").alias("k"), F.concat(F.lit("*"), F.char(F.col("id") + 97), F.lit("*")).alias("probe"))
    return xlookup(probes, "probe", _table(spark, sf_dir, "part"), "p_type", ["p_partkey"], "p_partkey", match=2).select("k", "p_partkey")


def _database(name, sql):
    @query(f"db_{name.lower()}", f"SELECT {sql} AS value FROM orders WHERE (o_orderpriority LIKE '1%' AND o_totalprice>200000) OR o_orderstatus='P'")
    def run(spark, sf_dir):
        from tabulon.operators.grouping import database

        out = database(_table(spark, sf_dir, "orders"), name, "o_totalprice", [{"o_orderpriority": "1-u", "o_totalprice": ">200000"}, {"o_orderstatus": "=p"}])
        return out.select(F.round(F.col("value").cast("double"), 3).alias("value"))


for _n, _s in {"DSUM": "sum(o_totalprice)", "DAVERAGE": "avg(o_totalprice)", "DCOUNT": "count(o_totalprice)", "DCOUNTA": "count(o_totalprice)", "DMAX": "max(o_totalprice)", "DMIN": "min(o_totalprice)", "DSTDEV": "stddev_samp(o_totalprice)", "DSTDEVP": "stddev_pop(o_totalprice)", "DVAR": "var_samp(o_totalprice)", "DVARP": "var_pop(o_totalprice)"}.items():
    _database(_n, f"round(CAST({_s} AS DOUBLE),3)")


@query("incremental_batch", "SELECT o_custkey, round(sum(CASE WHEN o_orderkey%100=0 THEN o_totalprice*2 ELSE o_totalprice END),2) AS total FROM orders GROUP BY o_custkey")
def _incremental(spark, sf_dir):
    from tabulon.streaming.changes import apply_changes, dirty_groups, recalculate

    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = lambda df: df.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    changes = orders.where("o_orderkey % 100 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("op", F.lit("set")).withColumn("change_id", F.col("o_orderkey"))
    dirty = dirty_groups(orders, changes, "o_orderkey", ["o_custkey"])
    return recalculate(total(orders), apply_changes(orders, changes, "o_orderkey"), dirty, ["o_custkey"], total)


@query("formula_chain", "SELECT o_orderkey, round(o_totalprice*2,4) AS b, round(o_totalprice*2+5,4) AS c FROM orders")
def _chain(spark, sf_dir):
    from tabulon.plans.formula import calculate

    out = calculate(_table(spark, sf_dir, "orders"), {"c": "=[@b]+5", "b": "=[@o_totalprice]*2"})
    return out.select("o_orderkey", F.round("b", 4).alias("b"), F.round("c", 4).alias("c"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
