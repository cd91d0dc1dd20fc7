"""Queries of the functions whose SQL needs more than a call: closed forms, defining sums and integrals, round trips.

DuckDB has no error function, no bonds and no solvers. A distribution is compared with its closed form at chosen
parameters or with Simpson's sum of its density, a bond with the sum of its discounted flows, an inverse with the value
that the forward function was given.
"""

from __future__ import annotations

_O, _P, _E, _C = ("orders", "o_orderkey"), ("part", "p_partkey"), ("events", "event_id"), ("customer", "c_custkey")
#: A share strictly between 0 and 1, a date and the half-years around it, as SQL.
_SHARE, _X = "(p_size/60.0::DOUBLE)", "(p_size::DOUBLE)"
_DAY = "o_orderdate::DATE"
_PCD = f"(CASE WHEN month({_DAY})<7 THEN make_date(year({_DAY}),1,1) ELSE make_date(year({_DAY}),7,1) END)"
_NCD = f"(CASE WHEN month({_DAY})<7 THEN make_date(year({_DAY}),7,1) ELSE make_date(year({_DAY})+1,1,1) END)"
_N = f"(2*(2030-year({_DAY}))-CASE WHEN month({_DAY})>=7 THEN 1 ELSE 0 END)"
_A, _D, _L = f"({_DAY}-{_PCD})::DOUBLE", f"({_NCD}-{_DAY})::DOUBLE", f"({_NCD}-{_PCD})::DOUBLE"
_SERIAL = lambda d: f"({d}-DATE '1899-12-30')"
_MATURITY = "DATE(2030,1,1)"
_RATE = "(0.02+o_custkey%50/1000.0::DOUBLE)"
_RATE_F = "0.02+MOD([@o_custkey],50)/1000"


def simpson(f: str, high: str, n: int = 400) -> str:
    """The integral of f (of t) from 0 to high."""
    return f"({high})/{3 * n}*list_sum(list_transform(range(0,{n + 1}), lambda i: (CASE WHEN i IN (0,{n}) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*({f.replace('@t', f'(i*({high})/{n})')})))"


def _phi(z: str) -> str:
    """The standard normal distribution at z, not beyond 8."""
    return f"(0.5+{simpson('exp(-@t*@t/2)/sqrt(2*pi())', f'greatest(-8.0,least(8.0,{z}))')})"


def _erf(x: str) -> str:
    return f"({simpson('2*exp(-@t*@t)/sqrt(pi())', f'least(6.0,{x})')})"


def _price(rate: str, yld: str, weight: str = "1", accrued: str | None = None) -> str:
    """Discounted flows of a half-yearly bond of 2030 at the order's date, each times weight (of its time k in periods)."""
    k, end = f"(i+{_D}/{_L})", f"({_N}-1+{_D}/{_L})"
    less = f"50*{rate}*{_A}/{_L}" if accrued is None else accrued
    return f"(list_sum(list_transform(range(0,{_N}), lambda i: 50*{rate}/pow(1+{yld}/2,{k})*({weight.replace('@k', k)})))+100/pow(1+{yld}/2,{end})*({weight.replace('@k', end)})-{less})"


_BOND = f"[@o_orderdate],{_MATURITY}"
_TERM = "180"
_BILL = "[@o_orderdate],[@o_orderdate_serial]+" + _TERM
_PERIOD = "(1+o_custkey%9)"
_GROWN = f"pow(1.01,{_PERIOD}-1)"
_PAY = "(-o_totalprice*0.01*pow(1.01,12)/(pow(1.01,12)-1))"
_IPMT = f"(-(o_totalprice*{_GROWN}+{_PAY}*({_GROWN}-1)/0.01)*0.01)"
_MAT = "DATE(2005,12,31)"
_DAYS = f"((DATE '2005-12-31'-{_DAY})::DOUBLE)"
_COMPLEX = "COMPLEX([@p_size],2)"
_R, _T = "sqrt(p_size*p_size+4.0::DOUBLE)", "atan2(2.0::DOUBLE,p_size)"
_PRODUCT = lambda n, k: f"exp(lgamma({n}+1)-lgamma({k}+1)-lgamma({n}-{k}+1))"
_SERIES = lambda sign: f"list_sum(list_transform(range(0,40), lambda k: {sign}pow(({_XB})/2.0,2*k+1)/exp(lgamma(k+1.0::DOUBLE)+lgamma(k+2.0::DOUBLE))))"
_XB = "(p_size/10.0::DOUBLE)"
_WEEKEND = f"greatest(isodow({_DAY})-5,0)"

#: name, table, formula, SQL; a name that ends in a plus is a second query of the function.
NUMBERS = [
    ("NORM.S.DIST", _P, "NORM.S.DIST([@p_size]/25-1,TRUE)", _phi("p_size/25.0::DOUBLE-1")), ("NORMSDIST", _P, "NORMSDIST([@p_size]/25-1)", _phi("p_size/25.0::DOUBLE-1")),
    ("NORM.DIST", _P, "NORM.DIST([@p_size],25,10,TRUE)", _phi("(p_size-25)/10.0::DOUBLE")), ("GAUSS", _P, "GAUSS([@p_size]/25)", f"{_phi('p_size/25.0::DOUBLE')}-0.5"),
    ("ERF", _P, "ERF([@p_size]/25)", _erf("p_size/25.0::DOUBLE")), ("ERF.PRECISE", _P, "ERF.PRECISE([@p_size]/25)", _erf("p_size/25.0::DOUBLE")), ("ERFC", _P, "ERFC([@p_size]/25)", f"1-{_erf('p_size/25.0::DOUBLE')}"), ("ERFC.PRECISE", _P, "ERFC.PRECISE([@p_size]/25)", f"1-{_erf('p_size/25.0::DOUBLE')}"),
    ("GAMMALN.PRECISE", _P, "GAMMALN.PRECISE([@p_size]/3)", "lgamma(p_size/3.0::DOUBLE)"), ("GAMMA.INV", _P, "GAMMA.INV([@p_size]/60,1,3)", f"-3*ln(1-{_SHARE})"),
    ("F.DIST", _P, "F.DIST([@p_size]/10,2,10,TRUE)", "1-pow(1+p_size/50.0::DOUBLE,-5)"), ("F.INV", _P, "F.INV([@p_size]/60,2,10)", f"5*(pow(1-{_SHARE},-0.2)-1)"), ("F.INV.RT", _P, "F.INV.RT([@p_size]/60,2,10)", f"5*(pow({_SHARE},-0.2)-1)"),
    ("T.DIST", _P, "T.DIST([@p_size]/10-2,2,TRUE)", "0.5+(p_size/10.0::DOUBLE-2)/(2*sqrt(2+pow(p_size/10.0::DOUBLE-2,2)))"), ("T.DIST.RT", _P, "T.DIST.RT([@p_size]/10,1)", "0.5-atan(p_size/10.0::DOUBLE)/pi()"), ("TDIST", _P, "TDIST([@p_size]/10,1,2)", "1-2*atan(p_size/10.0::DOUBLE)/pi()"),
    ("T.INV", _P, "T.INV([@p_size]/60,2)", f"(2*{_SHARE}-1)/sqrt(2*{_SHARE}*(1-{_SHARE}))"), ("T.INV.2T", _P, "T.INV.2T([@p_size]/60,1)", f"tan(pi()*(0.5-{_SHARE}/2))"),
    ("BETADIST", _P, "BETADIST([@p_size]/60,2,3)", f"6*pow({_SHARE},2)-8*pow({_SHARE},3)+3*pow({_SHARE},4)"), ("BETA.INV", _P, "BETA.INV([@p_size]/60,1,3)", f"1-pow(1-{_SHARE},1/3.0::DOUBLE)"),
    ("BINOM.DIST.RANGE", _P, "BINOM.DIST.RANGE(20,[@p_size]/60,3,5)", f"list_sum(list_transform(range(3,6), lambda k: {_PRODUCT('20.0::DOUBLE', 'k')}*pow({_SHARE},k)*pow(1-{_SHARE},20-k)))"), ("BINOM.INV", _P, "BINOM.INV(6,0.5,[@p_size]/60)", f"list_count(list_filter([1,7,22,42,57,63], lambda c: c/64.0::DOUBLE<{_SHARE}))"),
    ("HYPGEOM.DIST", _P, "HYPGEOM.DIST(1,4,[@p_size],60,FALSE)", f"p_size*{_PRODUCT('(60.0::DOUBLE-p_size)', '3')}/{_PRODUCT('60.0::DOUBLE', '4')}"), ("HYPGEOMDIST", _P, "HYPGEOMDIST(1,4,[@p_size],60)", f"p_size*{_PRODUCT('(60.0::DOUBLE-p_size)', '3')}/{_PRODUCT('60.0::DOUBLE', '4')}"),
    ("NEGBINOM.DIST", _P, "NEGBINOM.DIST(4,1,[@p_size]/60,TRUE)", f"1-pow(1-{_SHARE},5)"), ("NEGBINOMDIST", _P, "NEGBINOMDIST(4,2,[@p_size]/60)", f"5*pow({_SHARE},2)*pow(1-{_SHARE},4)"),
    ("BESSELJ", _P, "BESSELJ([@p_size]/10,1)", _SERIES("(CASE WHEN k%2=0 THEN 1 ELSE -1 END)*")), ("BESSELI", _P, "BESSELI([@p_size]/10,1)", _SERIES("")),
    ("BESSELK", _P, "BESSELK([@p_size]/10+1,1)", simpson(f"exp(-({_XB}+1)*cosh(@t))*cosh(@t)", "6.0::DOUBLE")),
    ("BESSELY", _P, "BESSELY([@p_size]/10+1,1)", f"({simpson(f'sin(({_XB}+1)*sin(@t)-@t)', 'pi()')}-{simpson(f'(exp(@t)-exp(-@t))*exp(-({_XB}+1)*sinh(@t))', '6.0::DOUBLE')})/pi()"),
    ("FACTDOUBLE", _P, "FACTDOUBLE(MOD([@p_size],15))", "coalesce(list_product(list_transform(range(p_size%15,0,-2), lambda k: k::DOUBLE)),1)"), ("MULTINOMIAL", _P, "MULTINOMIAL(MOD([@p_size],9),2,3)", "round(exp(lgamma(p_size%9+6.0::DOUBLE)-lgamma(p_size%9+1.0::DOUBLE))/12)"),
    ("SERIESSUM", _P, "SERIESSUM([@p_size]/60,0,2,{1,2,3})", f"1+2*pow({_SHARE},2)+3*pow({_SHARE},4)"),
    ("IMABS", _P, f"IMABS({_COMPLEX})", _R), ("IMARGUMENT", _P, f"IMARGUMENT({_COMPLEX})", _T), ("IMCONJUGATE", _P, f"IMAGINARY(IMCONJUGATE({_COMPLEX}))", "-2"),
    ("IMSUM", _P, f'IMREAL(IMSUM({_COMPLEX},"3-i"))+IMAGINARY(IMSUM({_COMPLEX},"3-i"))', "p_size+4"), ("IMSUB", _P, f'IMREAL(IMSUB({_COMPLEX},"3-i"))+10*IMAGINARY(IMSUB({_COMPLEX},"3-i"))', "p_size-3+30"),
    ("IMPRODUCT", _P, f'IMREAL(IMPRODUCT({_COMPLEX},"3-i"))+1000*IMAGINARY(IMPRODUCT({_COMPLEX},"3-i"))', "3*p_size+2+1000*(6-p_size)"), ("IMDIV", _P, f'IMREAL(IMDIV({_COMPLEX},"3-i"))', "(3*p_size-2)/10.0::DOUBLE"),
    ("IMEXP", _P, 'IMREAL(IMEXP(COMPLEX([@p_size]/10,2)))', "exp(p_size/10.0::DOUBLE)*cos(2)"), ("IMLN", _P, f"IMREAL(IMLN({_COMPLEX}))+IMAGINARY(IMLN({_COMPLEX}))", f"ln({_R})+{_T}"),
    ("IMSQRT", _P, f"IMREAL(IMSQRT({_COMPLEX}))", f"sqrt({_R})*cos({_T}/2)"), ("IMPOWER", _P, f"IMREAL(IMPOWER({_COMPLEX},3))", f"pow({_R},3)*cos(3*{_T})"),
    ("DATEVALUE", _O, 'DATEVALUE(CONCAT("2024-0",MOD([@o_custkey],9)+1,"-15"))', "make_date(2024,(o_custkey%9+1)::INTEGER,15)-DATE '1899-12-30'"), ("TIMEVALUE", _O, 'TIMEVALUE(CONCAT(MOD([@o_custkey],24),":30"))', "(o_custkey%24)/24.0::DOUBLE+1/48.0::DOUBLE"),
    ("HOUR", _O, "HOUR([@o_custkey]/24+0.001)", "o_custkey%24"), ("MINUTE", _O, "MINUTE([@o_custkey]/1440+0.0001)", "o_custkey%60"), ("SECOND", _O, "SECOND([@o_custkey]/86400)", "o_custkey%60"), ("TIME", _O, "TIME(MOD([@o_custkey],24),30,36)", "(o_custkey%24)/24.0::DOUBLE+1836/86400.0::DOUBLE"),
    ("TODAY", _O, "TODAY([@o_custkey]+0.7)", "o_custkey"), ("NOW", _O, "NOW([@o_custkey]+0.7)", "o_custkey+0.7"),
    ("WEEKNUM", _O, "WEEKNUM([@o_orderdate],2)", f"(dayofyear({_DAY})-1+isodow(make_date(year({_DAY}),1,1))-1)//7+1"), ("DAYS360", _O, "DAYS360([@o_orderdate],DATE(2000,5,30),TRUE)", f"360*(2000-year({_DAY}))+30*(5-month({_DAY}))+30-least(day({_DAY}),30)"),
    ("NETWORKDAYS", _O, "NETWORKDAYS([@o_orderdate],EDATE([@o_orderdate],1))", f"list_count(list_filter(range({_DAY}::TIMESTAMP,({_DAY}+INTERVAL 1 MONTH)::TIMESTAMP+INTERVAL 1 DAY,INTERVAL 1 DAY), lambda d: isodow(d)<6))"),
    ("NETWORKDAYS.INTL", _O, "NETWORKDAYS.INTL([@o_orderdate],EDATE([@o_orderdate],1),11)", f"list_count(list_filter(range({_DAY}::TIMESTAMP,({_DAY}+INTERVAL 1 MONTH)::TIMESTAMP+INTERVAL 1 DAY,INTERVAL 1 DAY), lambda d: isodow(d)<7))"),
    ("WORKDAY", _O, "WORKDAY([@o_orderdate],10)", f"{_SERIAL(_DAY)}-{_WEEKEND}+14"), ("WORKDAY.INTL", _O, "WORKDAY.INTL([@o_orderdate],12,11)", f"{_SERIAL(_DAY)}-greatest(isodow({_DAY})-6,0)+14"),
    ("DB", _O, "DB([@o_custkey]+1000,([@o_custkey]+1000)/10,6,2)", "(o_custkey+1000)*(1-0.319)*0.319"), ("IPMT", _O, "IPMT(0.01,1+MOD([@o_custkey],9),12,[@o_totalprice])", _IPMT), ("PPMT", _O, "PPMT(0.01,1+MOD([@o_custkey],9),12,[@o_totalprice])", f"{_PAY}-{_IPMT}"),
    ("NPER", _O, "NPER(0.01,-[@o_totalprice],[@o_totalprice]*10)", "-ln(1-0.1)/ln(1.01)"), ("NPV", _O, "NPV(0.1,[@o_totalprice],100)", "o_totalprice/1.1+100/1.21"),
    ("IRR", _O, "IRR({-[@o_totalprice],50000,150000})", "(50000+sqrt(2500000000.0::DOUBLE+600000*o_totalprice))/(2*o_totalprice)-1"), ("MIRR", _O, "MIRR({-[@o_totalprice],50000,150000},0.1,0.12)", "sqrt((50000*1.12+150000)/o_totalprice)-1"),
    ("RATE", _O, "RATE(2,0,-[@o_totalprice],200000)", "sqrt(200000/o_totalprice)-1"), ("XIRR", _O, "XIRR({-[@o_totalprice],150000},{DATE(2021,1,1),DATE(2022,1,1)})", "150000/o_totalprice-1"),
    ("FVSCHEDULE", _O, "FVSCHEDULE([@o_totalprice],{0.01,0.02})", "o_totalprice*1.01*1.02"), ("DOLLARDE", _O, "DOLLARDE([@o_custkey]+0.05,16)", "o_custkey+5/16.0::DOUBLE"), ("DOLLARFR", _O, "DOLLARFR([@o_custkey]+0.25,16)", "o_custkey+0.04"),
    ("DISC", _O, f"DISC([@o_orderdate],{_MAT},95,100,2)", f"0.05*360/{_DAYS}"), ("INTRATE", _O, f"INTRATE([@o_orderdate],{_MAT},95,100,3)", f"5/95.0::DOUBLE*365/{_DAYS}"), ("PRICEDISC", _O, f"PRICEDISC([@o_orderdate],{_MAT},0.05,100,2)", f"100*(1-0.05*{_DAYS}/360)"),
    ("RECEIVED", _O, f"RECEIVED([@o_orderdate],{_MAT},1000,0.05,2)", f"1000/(1-0.05*{_DAYS}/360)"), ("YIELDDISC", _O, f"YIELDDISC([@o_orderdate],{_MAT},95,100,2)", f"5/95.0::DOUBLE*360/{_DAYS}"), ("ACCRINTM", _O, f"ACCRINTM([@o_orderdate],{_MAT},0.06,1000,3)", f"60*{_DAYS}/365"),
    ("PRICEMAT", _O, f"PRICEMAT([@o_orderdate],{_MAT},DATE(1990,1,1),0.06,0.05,3)", f"100*(1+((DATE '2005-12-31'-DATE '1990-01-01')/365.0::DOUBLE)*0.06)/(1+{_DAYS}/365*0.05)-6*({_DAY}-DATE '1990-01-01')/365.0::DOUBLE"),
    ("YIELDMAT", _O, f"YIELDMAT([@o_orderdate],{_MAT},DATE(1990,1,1),0.06,100,3)", f"((1+((DATE '2005-12-31'-DATE '1990-01-01')/365.0::DOUBLE)*0.06)/(1+0.06*({_DAY}-DATE '1990-01-01')/365.0::DOUBLE)-1)/({_DAYS}/365)"),
    ("TBILLPRICE", _O, "TBILLPRICE([@o_orderdate],EDATE([@o_orderdate],3),0.05)", f"100*(1-0.05*(({_DAY}+INTERVAL 3 MONTH)::DATE-{_DAY})/360.0::DOUBLE)"), ("TBILLYIELD", _O, "TBILLYIELD([@o_orderdate],EDATE([@o_orderdate],3),98)", f"2/98.0::DOUBLE*360/(({_DAY}+INTERVAL 3 MONTH)::DATE-{_DAY})"),
    ("TBILLEQ", _O, "TBILLEQ([@o_orderdate],EDATE([@o_orderdate],3),0.05)", f"365*0.05/(360-0.05*(({_DAY}+INTERVAL 3 MONTH)::DATE-{_DAY}))"),
    ("COUPNUM", _O, f"COUPNUM({_BOND},2,1)", _N), ("COUPPCD", _O, f"COUPPCD({_BOND},2,1)", _SERIAL(_PCD)), ("COUPNCD", _O, f"COUPNCD({_BOND},2,1)", _SERIAL(_NCD)), ("COUPDAYBS", _O, f"COUPDAYBS({_BOND},2,1)", _A), ("COUPDAYS", _O, f"COUPDAYS({_BOND},2,1)", _L), ("COUPDAYSNC", _O, f"COUPDAYSNC({_BOND},2,1)", _D),
    ("PRICE", _O, f"PRICE({_BOND},0.06,{_RATE_F},100,2,1)", _price("0.06", _RATE)), ("YIELD", _O, f"YIELD({_BOND},0.06,PRICE({_BOND},0.06,{_RATE_F},100,2,1),100,2,1)", _RATE),
    ("DURATION", _O, f"DURATION({_BOND},0.06,{_RATE_F},2,1)", f"{_price('0.06', _RATE, '@k/2', '0')}/{_price('0.06', _RATE, '1', '0')}"), ("MDURATION", _O, f"MDURATION({_BOND},0.06,{_RATE_F},2,1)", f"{_price('0.06', _RATE, '@k/2', '0')}/{_price('0.06', _RATE, '1', '0')}/(1+{_RATE}/2)"),
    ("ACCRINT", _O, f"ACCRINT(COUPPCD({_BOND},2,1),COUPNCD({_BOND},2,1),[@o_orderdate],0.06,1000,2,1)", f"CASE WHEN {_A}>0 THEN 30*{_A}/{_L} END"),
    ("ODDFPRICE", _O, f"ODDFPRICE([@o_orderdate],{_MATURITY},COUPPCD({_BOND},2,1),COUPNCD({_BOND},2,1),0.06,{_RATE_F},100,2,1)", f"CASE WHEN {_A}>0 THEN {_price('0.06', _RATE)} END"),
    ("ODDFYIELD", _O, f"ODDFYIELD([@o_orderdate],{_MATURITY},COUPPCD({_BOND},2,1),COUPNCD({_BOND},2,1),0.06,PRICE({_BOND},0.06,{_RATE_F},100,2,1),100,2,1)", f"CASE WHEN {_A}>0 THEN {_RATE} END"),
    ("ODDLPRICE", _O, f"ODDLPRICE([@o_orderdate],COUPNCD({_BOND},2,1),COUPPCD({_BOND},2,1),0.06,{_RATE_F},100,2,1)", f"CASE WHEN {_A}>0 THEN 103/(1+{_D}/{_L}*{_RATE}/2)-3*{_A}/{_L} END"),
    ("ODDLYIELD", _O, f"ODDLYIELD([@o_orderdate],COUPNCD({_BOND},2,1),COUPPCD({_BOND},2,1),0.06,ODDLPRICE([@o_orderdate],COUPNCD({_BOND},2,1),COUPPCD({_BOND},2,1),0.06,{_RATE_F},100,2,1),100,2,1)", f"CASE WHEN {_A}>0 THEN {_RATE} END"),
    ("N", _P, "N([@p_name])+N([@p_size])", "p_size"), ("TYPE", _P, "TYPE([@p_name])*10+TYPE([@p_size])", "21"), ("TRUE", _P, "IF(TRUE(),[@p_size],0)", "p_size"), ("FALSE", _P, "IF(FALSE(),0,[@p_size])", "p_size"),
]

#: The same for results that aren't numbers.
TEXTS = [
    ("BIN2HEX", _O, "BIN2HEX(DEC2BIN(MOD([@o_custkey],512)))", "upper(to_hex(o_custkey%512))"), ("BIN2OCT", _O, "BIN2OCT(DEC2BIN(MOD([@o_custkey],8)))", "CAST(o_custkey%8 AS VARCHAR)"), ("HEX2BIN", _O, "HEX2BIN(DEC2HEX(MOD([@o_custkey],512)))", "to_binary(o_custkey%512)"),
    ("HEX2OCT", _O, "HEX2OCT(DEC2HEX(MOD([@o_custkey],8)))", "CAST(o_custkey%8 AS VARCHAR)"), ("OCT2BIN", _O, "OCT2BIN(DEC2OCT(MOD([@o_custkey],512)))", "to_binary(o_custkey%512)"), ("OCT2HEX", _O, "OCT2HEX(DEC2OCT([@o_custkey]))", "upper(to_hex(o_custkey))"),
    ("ADDRESS", _O, "ADDRESS([@o_custkey]+1,MOD([@o_custkey],26)+1)", "'$'||chr((65+o_custkey%26)::INTEGER)||'$'||(o_custkey+1)"), ("HYPERLINK", _P, 'HYPERLINK("http://x/",[@p_name])', "p_name"), ("CHAR", _O, "CHAR(65+MOD([@o_custkey],26))", "chr((65+o_custkey%26)::INTEGER)"), ("UNICHAR", _O, "UNICHAR(945+MOD([@o_custkey],20))", "chr((945+o_custkey%20)::INTEGER)"),
    ("DOLLAR", _O, "DOLLAR([@o_custkey]+0.25)", "'$'||format('{:,.2f}',o_custkey+0.25::DOUBLE)"), ("VALUETOTEXT", _P, "VALUETOTEXT([@p_name],1)", "'\"'||p_name||'\"'"), ("REGEXREPLACE", _P, 'REGEXREPLACE([@p_name],"[aeiou]","_")', "regexp_replace(p_name,'[aeiou]','_','g')"),
    ("TEXTSPLIT", _P, 'ARRAYTOTEXT(TEXTSPLIT([@p_name]," "))', "replace(p_name,' ',', ')"), ("ARRAYTOTEXT", _P, 'ARRAYTOTEXT(TEXTSPLIT([@p_name]," "),1)', "'{'||replace(p_name,' ',';')||'}'"),
    ("PROPER", _P, "PROPER([@p_name])", "list_aggregate(list_transform(string_split(p_name,' '), lambda w: upper(w[1])||lower(w[2:])),'string_agg',' ')"), ("T", _P, "T([@p_name])", "p_name"), ("ISLOGICAL", _P, "ISLOGICAL([@p_size]>10)", "true"), ("ISNONTEXT", _P, "ISNONTEXT([@p_name])", "false"),
    ("TEXT", _O, 'TEXT([@o_custkey]+0.25,"#,##0.00")', "format('{:,.2f}',o_custkey+0.25::DOUBLE)"),
    ("ROMAN", _O, "ROMAN([@o_custkey]+1)", "repeat('M',((o_custkey+1)//1000)::INTEGER)||['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][((o_custkey+1)%1000//100+1)::INTEGER]||['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][((o_custkey+1)%100//10+1)::INTEGER]||['','I','II','III','IV','V','VI','VII','VIII','IX'][((o_custkey+1)%10+1)::INTEGER]"),
]

_T_DENSITY = "exp(lgamma(({v}+1)/2)-lgamma({v}/2))/sqrt({v}*pi())*pow(1+@t*@t/{v},-({v}+1)/2)"


def _two_tails(t: str, v: str) -> str:
    return f"1-2*{simpson(_T_DENSITY.format(v=v), t)}"


_MEANS = "abs(avg(c_acctbal)-avg(c_nationkey*370.0))"
_VARIANCES = ("var_samp(c_acctbal)", "var_samp(c_nationkey*370.0)", "count(*)::DOUBLE")
#: Aggregates over customer by market segment.
AGGREGATES = [
    ("T.TEST", "T.TEST([c_acctbal],[c_nationkey]*370,2,2)", _two_tails(f"{_MEANS}/sqrt(({_VARIANCES[0]}+{_VARIANCES[1]})/{_VARIANCES[2]})", f"(2*{_VARIANCES[2]}-2)")),
    ("F.TEST", "F.TEST([c_acctbal],[c_nationkey]*370)", None),
    ("Z.TEST", "Z.TEST([c_acctbal],4500)", f"1-{_phi('(avg(c_acctbal)-4500)/(stddev_samp(c_acctbal)/sqrt(count(*)))')}"),
    ("PEARSON", "PEARSON([c_acctbal],[c_nationkey])", "corr(c_acctbal,c_nationkey)"), ("MODE.SNGL", "MODE.SNGL([c_nationkey])", None),
    ("PRODUCT", "PRODUCT(1+[c_nationkey]/1000)", "product(1+c_nationkey/1000.0::DOUBLE)"),
    ("LINEST", "INDEX(LINEST([c_acctbal],[c_nationkey]),1)+INDEX(LINEST([c_acctbal],[c_nationkey]),2)", "regr_slope(c_acctbal,c_nationkey)+regr_intercept(c_acctbal,c_nationkey)"),
    ("LOGEST", "INDEX(LOGEST([c_nationkey]+1,[c_acctbal]),2)", "exp(regr_intercept(ln(c_nationkey+1),c_acctbal))"),
    ("SUM+", "SUM([c_acctbal],[c_nationkey],1)", "sum(c_acctbal)+sum(c_nationkey)+1"), ("AVERAGE+", "AVERAGE([c_acctbal],[c_nationkey])", "(sum(c_acctbal)+sum(c_nationkey))/(2*count(*))"), ("MIN+", "MIN([c_acctbal],[c_nationkey])", "least(min(c_acctbal),min(c_nationkey))"), ("MAX+", "MAX([c_acctbal],[c_nationkey])", "greatest(max(c_acctbal),max(c_nationkey))"),
    ("COUNT+", "COUNT([c_acctbal],[c_nationkey],[c_name])", "2*count(*)"), ("COUNTA+", "COUNTA([c_acctbal],[c_name])", "2*count(*)"), ("SUMSQ+", "SUMSQ([c_acctbal],[c_nationkey])", "sum(c_acctbal*c_acctbal)+sum(c_nationkey*c_nationkey)"),
    ("VAR.S+", "VAR.S([c_acctbal],[c_nationkey]*370)", "(sum(pow(c_acctbal,2))+sum(pow(c_nationkey*370.0::DOUBLE,2))-pow(sum(c_acctbal)+sum(c_nationkey*370.0::DOUBLE),2)/(2*count(*)))/(2*count(*)-1)"),
    ("STDEV.P+", "STDEV.P([c_acctbal],[c_nationkey]*370)", "sqrt((sum(pow(c_acctbal,2))+sum(pow(c_nationkey*370.0::DOUBLE,2))-pow(sum(c_acctbal)+sum(c_nationkey*370.0::DOUBLE),2)/(2*count(*)))/(2*count(*)))"),
    ("GEOMEAN+", "GEOMEAN([c_nationkey]+1,[c_custkey]+1)", "exp((sum(ln(c_nationkey+1))+sum(ln(c_custkey+1)))/(2*count(*)))"),
]
