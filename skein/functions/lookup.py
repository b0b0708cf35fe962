"""Closed vocabularies and lookups: industry divisions, theme hierarchy, filing items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Divisions of the Standard Industrial Classification by major group (first two digits).
DIVISIONS = ((1, 9, "Agriculture"), (10, 14, "Mining"), (15, 17, "Construction"), (20, 39, "Manufacturing"), (40, 49, "Transport & Utilities"), (50, 51, "Wholesale"), (52, 59, "Retail"), (60, 67, "Finance"), (70, 89, "Services"), (90, 99, "Public"))

#: Descriptions of the items of a current report.
ITEMS = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation",
    "2.04": "Triggering Events That Accelerate a Financial Obligation",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting or Failure to Satisfy a Listing Rule",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure of Directors or Certain Officers; Election of Directors",
    "5.03": "Amendments to Articles of Incorporation or Bylaws",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}
#: What an item claims, and its stance.
ITEM_CLAIMS = {
    "1.03": ("risk_flag", "bearish"),
    "2.04": ("risk_flag", "bearish"),
    "2.06": ("risk_flag", "bearish"),
    "3.01": ("risk_flag", "bearish"),
    "4.02": ("risk_flag", "bearish"),
    "4.01": ("risk_flag", "cautious"),
    "5.01": ("risk_flag", "cautious"),
    "5.02": ("risk_flag", "cautious"),
    "2.05": ("risk_flag", "cautious"),
    "2.02": ("sentiment", "neutral"),
}


def division(code: Column) -> Column:
    """The division of a SIC code (text or number of up to four digits); "Other" outside all."""
    major = F.substring(F.lpad(code.cast("string"), 4, "0"), 1, 2).try_cast("int")
    out = None
    for lo, hi, name in DIVISIONS:
        out = F.when(major.between(lo, hi), name) if out is None else out.when(major.between(lo, hi), name)
    return out.otherwise("Other")


def classify(df: DataFrame, code: str, exact: DataFrame, prefix: DataFrame, out: str = "sector", fallback: str = "Other") -> DataFrame:
    """Look a code up: the exact table first, then its two-digit prefix, then the fallback. exact, prefix: (code, label)."""
    e, p = exact.select(F.col("code").alias("_e"), F.col("label").alias("_el")), prefix.select(F.col("code").alias("_p"), F.col("label").alias("_pl"))
    got = df.join(e, F.col(code) == F.col("_e"), "left").join(p, F.substring(F.col(code), 1, 2) == F.col("_p"), "left")
    return got.withColumn(out, F.coalesce("_el", "_pl", F.lit(fallback))).drop("_e", "_el", "_p", "_pl")


def symbol(venue: Column, ticker: Column) -> Column:
    """Ticker with the venue's suffix for the two Korean markets."""
    return F.when(venue.isin("KS", "KQ"), F.concat(ticker, F.lit("."), venue)).otherwise(ticker)


def display_name(name: Column, share_class: Column) -> Column:
    return F.when(share_class == "preferred", F.concat(name, F.lit(" (preferred)"))).otherwise(name)


def market_cap(native: Column, shares: Column, last: Column, raw: Column) -> Column:
    """The venue's own figure; else shares times the last close, if both are there; else what was given."""
    return F.coalesce(native, F.when((shares > 0) & (last > 0), F.round(shares * last)), raw)


def item_text(items: Column) -> Column:
    """``1.01 Entry ...; 8.01 Other ...`` of comma-separated item codes."""
    names = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    return F.array_join(F.transform(F.split(items, ","), lambda c: F.concat_ws(" ", F.trim(c), F.try_element_at(names, F.trim(c)))), "; ")


def with_parents(themes: DataFrame) -> DataFrame:
    """``theme_id, label, parent_id, level``: level 0 for spine themes, 1 for what hangs below one."""
    return themes.withColumn("level", F.when(F.col("parent_id").isNull(), 0).otherwise(1))


def forbidden(text: Column, words: tuple[str, ...] = ("buy", "sell", "매수", "매도", "목표가", "price target", "strong buy")) -> Column:
    """The vocabulary (fixed values) that no published text may hold, as found in it."""
    return F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())


#: Conglomerate families and the parts of a name that tell them.
FAMILIES = {
    "삼성": ("삼성", "samsung"),
    "SK": ("SK", "에스케이"),
    "LG": ("LG", "엘지"),
    "현대차": ("현대차", "현대자동차", "기아", "현대모비스", "현대글로비스"),
    "HD현대": ("HD현대", "현대중공업", "현대일렉트릭", "현대미포", "한국조선해양"),
    "효성": ("효성",),
    "포스코": ("포스코", "posco"),
    "롯데": ("롯데", "lotte"),
    "한화": ("한화",),
    "CJ": ("CJ",),
    "GS": ("GS",),
    "두산": ("두산", "doosan"),
    "신세계": ("신세계", "이마트"),
    "코오롱": ("코오롱",),
    "한진": ("한진", "대한항공"),
    "DB": ("DB하이텍", "DB금융", "DB손해"),
    "OCI": ("OCI",),
    "HD": ("하이트진로",),
}
#: What a holding's name adds to that of its group.
HOLDING_PARTS = ("Holdings", "홀딩스", "사이언스", "그룹", "지주")


def family(name: Column, families: dict[str, tuple[str, ...]] = FAMILIES) -> Column:
    """The first family one of whose parts is in the name; null for none."""
    return F.coalesce(*[F.when(F.lower(name).rlike("|".join(f"\\Q{p.lower()}\\E" for p in parts)), F.lit(f)) for f, parts in families.items()])


def same_group(a: Column, b: Column, families: dict[str, tuple[str, ...]] = FAMILIES) -> Column:
    """One family; or one name starts with the other (two characters or more, spaces apart); or they differ by a holding's part only."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    starts = ((F.length(x) >= 2) & F.startswith(y, x)) | ((F.length(y) >= 2) & F.startswith(x, y))
    bare = lambda c, p: F.trim(F.replace(c, F.lit(p), F.lit("")))
    out = F.coalesce(family(a, families) == family(b, families), F.lit(False)) | starts
    for p in HOLDING_PARTS:
        out = out | ((bare(a, p) == bare(b, p)) & (a != b))
    return out


def in_universe(issuer_id: Column, membership: Column) -> Column:
    """Korean issuers always; all others if they are members of an index."""
    return issuer_id.startswith("DART") | (F.coalesce(membership, F.lit("")) != "")


#: Korean names of the eleven sectors.
SECTOR_KO = {
    "Technology": "기술",
    "Healthcare": "헬스케어",
    "Financial": "금융",
    "Consumer Cyclical": "경기소비재",
    "Consumer Defensive": "필수소비재",
    "Communication Services": "커뮤니케이션",
    "Industrials": "산업재",
    "Energy": "에너지",
    "Basic Materials": "소재",
    "Real Estate": "부동산",
    "Utilities": "유틸리티",
}
#: SIC codes by sector and industry.
SIC_INDUSTRIES = {
    "Basic Materials": {
        "Agricultural Inputs": "2870",
        "Chemicals": "2810 2821 2860",
        "Gold": "1040",
        "Other Industrial Metals & Mining": "1400 3357",
        "Paper & Paper Products": "2621 2670",
        "Specialty Chemicals": "2851",
        "Steel": "3312",
    },
    "Communication Services": {"Advertising Agencies": "7311", "Broadcasting": "3663", "Telecom Services": "4841"},
    "Consumer Cyclical": {
        "Apparel Manufacturing": "2300 2320",
        "Apparel Retail": "5651",
        "Auto & Truck Dealerships": "5500",
        "Auto Manufacturers": "3711",
        "Auto Parts": "5013",
        "Footwear & Accessories": "3021 3100",
        "Furnishings, Fixtures & Appliances": "3630",
        "Home Improvement Retail": "5200 5211 5700",
        "Internet Retail": "5961",
        "Leisure": "7990",
        "Lodging": "7011",
        "Packaging & Containers": "2650 3411",
        "Residential Construction": "1520",
        "Restaurants": "5810 5812",
        "Specialty Retail": "5731 5990 7841",
    },
    "Consumer Defensive": {
        "Beverages": "2080 2086",
        "Beverages - Brewers": "2082",
        "Confectioners": "2060",
        "Discount Stores": "5331",
        "Farm Products": "0100",
        "Food Distribution": "5140",
        "Grocery Stores": "5411",
        "Household & Personal Products": "2840 2842 2844",
        "Packaged Foods": "2000 2011 2033 2040 2070",
        "Tobacco": "2111",
    },
    "Energy": {"Oil & Gas": "1311 6792", "Oil & Gas Equipment & Services": "1389", "Oil & Gas Midstream": "4922", "Oil & Gas Refining & Marketing": "2911"},
    "Financial": {
        "Asset Management": "6282",
        "Banks": "6021 6022",
        "Capital Markets": "6199 6200 6211",
        "Insurance - Diversified": "6399",
        "Insurance - Life": "6311",
        "Insurance - Property & Casualty": "6331",
        "Insurance Brokers": "6411",
    },
    "Healthcare": {
        "Biotechnology": "2835 2836 8731",
        "Diagnostics & Research": "3826 8071",
        "Drug Manufacturers - General": "2834",
        "Healthcare Plans": "6324",
        "Medical Care Facilities": "8062",
        "Medical Devices": "3841 3845",
        "Medical Distribution": "5047 5122",
        "Medical Instruments & Supplies": "3842 3851",
        "Pharmaceutical Retailers": "5912",
    },
    "Industrials": {
        "Aerospace & Defense": "3720 3724 3730 3812",
        "Airlines": "4512",
        "Building Products & Equipment": "3430 3585",
        "Consulting Services": "7320 8700",
        "Electrical Equipment & Parts": "3600 3621",
        "Engineering & Construction": "1600 1731",
        "Farm & Heavy Construction Machinery": "3523 3531",
        "Integrated Freight & Logistics": "4513 4700 4731",
        "Marine Shipping": "4400",
        "Metal Fabrication": "3490",
        "Railroads": "4011",
        "Specialty Business Services": "7340 7389",
        "Specialty Industrial Machinery": "3550 3559 3560 3561 3569 3590",
        "Tools & Accessories": "3420",
        "Trucking": "4210",
        "Waste Management": "4953",
    },
    "Real Estate": {"REIT": "6798", "Real Estate - Services": "6510"},
    "Technology": {
        "Communication Equipment": "3576 3661 3669",
        "Computer Hardware": "3570 3572 3577",
        "Consumer Electronics": "3571",
        "Electronic Components": "3672",
        "Information Technology Services": "7370 7371 7373 7374",
        "Scientific & Technical Instruments": "3823 3825 3829",
        "Semiconductors": "3674",
        "Software": "7372",
    },
    "Utilities": {"Utilities-Independent Power Producers": "4991", "Utilities-Regulated Electric": "4911 4931"},
}
#: Sectors of SIC major groups, for codes that aren't listed.
SIC_GROUPS = {
    "Basic Materials": "08 09 10 12 14 24 26 28 32 33",
    "Communication Services": "27 48 78",
    "Consumer Cyclical": "22 23 25 30 31 39 50 52 53 55 56 57 58 59 70 72 79",
    "Consumer Defensive": "01 02 07 20 21 51 54 82",
    "Energy": "13 29",
    "Financial": "60 61 62 63 64 67",
    "Healthcare": "80",
    "Industrials": "15 16 17 34 35 37 40 41 42 44 45 47 87",
    "Real Estate": "65",
    "Technology": "36 38 73",
    "Utilities": "49",
}
#: Names of KSIC divisions (first two digits).
KSIC_NAMES = {
    "01": "농업", "03": "어업", "05": "석탄광업", "06": "원유·가스", "07": "금속광업", "10": "식료품", "11": "음료", "13": "섬유", "14": "의복",
    "16": "목재", "17": "펄프·종이", "18": "인쇄", "19": "석유정제", "20": "화학", "21": "의약품", "22": "고무·플라스틱", "23": "비금속광물",
    "24": "1차금속", "25": "금속가공", "26": "전자부품·반도체", "27": "의료·정밀기기", "28": "전기장비", "29": "기계·장비", "30": "자동차",
    "31": "운송장비", "32": "가구", "33": "기타제조", "35": "전기·가스", "36": "수도", "38": "폐기물", "41": "건설", "42": "토목", "46": "도매",
    "47": "소매", "49": "육상운송", "50": "수상운송", "51": "항공운송", "52": "창고·운송지원", "55": "숙박", "56": "음식점", "58": "출판",
    "59": "영상·방송", "61": "통신", "62": "소프트웨어", "63": "정보서비스", "64": "금융", "65": "보험", "66": "금융지원", "68": "부동산",
    "70": "연구개발", "71": "전문서비스", "72": "건축·엔지니어링", "73": "기타전문", "75": "사업지원서비스", "85": "교육", "86": "보건",
    "90": "예술", "91": "스포츠·여가", "96": "개인서비스",
}
#: Sectors of KSIC names.
KSIC_SECTORS = {
    "Basic Materials": "화학 고무·플라스틱 펄프·종이 비금속광물 금속광업 목재 인쇄",
    "Communication Services": "통신 출판 영상·방송 예술",
    "Consumer Cyclical": "자동차 운송장비 의복 섬유 소매 가구 숙박 음식점 가죽·신발 스포츠·여가 개인서비스 사업지원서비스",
    "Consumer Defensive": "식료품 음료 도매",
    "Energy": "석유정제 원유·가스",
    "Financial": "금융 보험 금융지원",
    "Healthcare": "의약품 보건",
    "Industrials": "기계·장비 전기장비 건설 토목 육상운송 수상운송 항공운송 창고·운송지원 금속가공 1차금속 전문서비스 건축·엔지니어링 연구개발 기타전문 폐기물",
    "Real Estate": "부동산",
    "Technology": "전자부품·반도체 의료·정밀기기 소프트웨어 정보서비스",
    "Utilities": "전기·가스 수도",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _listed(groups: dict[str, str]) -> dict[str, str]:
    return {code: name for name, codes in groups.items() for code in codes.split()}


def _sector(sector: Column, industry: Column) -> Column:
    return F.struct(F.coalesce(F.try_element_at(_map(SECTOR_KO), sector), F.lit("기타")).alias("sector_ko"), F.coalesce(industry, F.lit("Other")).alias("industry"), F.coalesce(sector, F.lit("Other")).alias("sector"))


def sic_sector(code: Column) -> Column:
    """``(sector_ko, industry, sector)`` of a SIC code: the listed code, else its major group, else 기타 / Other / Other."""
    c = F.trim(code.cast("string"))
    of = {k: (s, i) for s, inds in SIC_INDUSTRIES.items() for i, ks in inds.items() for k in ks.split()}
    exact, industry = (F.try_element_at(_map({k: v[n] for k, v in of.items()}), c) for n in (0, 1))
    # (an empty code has no group; longer codes keep their first two digits)
    group = F.try_element_at(_map(_listed(SIC_GROUPS)), F.when(c != "", F.substring(F.when(F.length(c) < 4, F.lpad(c, 4, "0")).otherwise(c), 1, 2)))
    sector = F.coalesce(exact, group)
    return _sector(sector, F.coalesce(industry, group))


def ksic_name(code: Column) -> Column:
    """The division's name of a KSIC code, else 기타(code)."""
    c = F.coalesce(code.cast("string"), F.lit(""))
    return F.coalesce(F.try_element_at(_map(KSIC_NAMES), F.substring(c, 1, 2)), F.concat(F.lit("기타("), c, F.lit(")")))


def ksic_sector(name: Column) -> Column:
    """The same as :func:`sic_sector` of a KSIC name, which stays as the industry."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return _sector(F.try_element_at(_map(_listed(KSIC_SECTORS)), n), F.nullif(n, F.lit("")))


def parsed(text: Column, schema: str) -> Column:
    """JSON text by its schema; null for null, empty or broken text, so that one bad row stops nothing."""
    return F.from_json(F.when(F.trim(text) != "", text), schema, {"mode": "PERMISSIVE"})
