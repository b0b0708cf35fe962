"""Word lists. They decide stances, grounding and material events, and are parameters everywhere."""

BULLISH = ("급등", "호재", "사상최대", "상한가", "대박", "강세", "수주", "출시", "신고가", "돌파", "흑자전환", "최대 실적", "체결", "surge", "beat", "record", "upgrade", "breakthrough", "rally", "jump")
BEARISH = (
    "급락", "우려", "적자", "소송", "감액", "분식", "하락", "악재", "리스크", "미치지 못", "불확실", "경고", "배제할 수 없",
    "사망", "제재", "횡령", "적자전환", "하향", "약세", "부진", "폭락", "상장폐지", "취소", "철회", "무산", "반려",
    "risk", "probe", "lawsuit", "downgrade", "fraud", "loss", "warns", "plunge",
    "falls", "falling", "declines", "decline", "slumps", "tumbles", "plunges", "sell-off",
)
NEGATION = ("아니", "없", "부인", "반박", "overblown", "denied", "refuted", "false", "not", "no")
HEDGE = ("수도", "가능성", "추정", "reportedly", "allegedly", "may", "could", "uncertain", "rumored")
ATTRIBUTION = ("주장", "따르면", "측은", "alleges", "claims", "according", "skeptics", "제보")
MATERIAL = ("감리", "분식", "리콜", "소송", "횡령", "제보", "내부고발", "회계부정", "fraud", "lawsuit", "probe", "recall", "embezzle", "whistlebl")
#: Parts of the names of outlets whose headlines are shown.
QUALITY_OUTLETS = (
    "reuters", "bloomberg", "wall street journal", "wsj", "financial times", "ft.com", "cnbc", "marketwatch", "barron", "forbes", "new york times",
    "associated press", "ap news", "the motley fool", "business wire", "globe and mail", "yahoo finance", "fortune", "the economist", "axios",
    "cnn business", "guardian", "nikkei", "financial juice", "investor's business daily", "investors business daily", "kiplinger", "매일경제",
    "한국경제", "연합뉴스", "조선비즈", "chosunbiz", "ked global", "뉴스핌", "서울경제", "머니투데이", "이데일리", "한겨레", "중앙일보", "동아일보",
    "조선일보", "jtbc", "sbs", "kbs", "mbc", "뉴시스", "daum", "네이트", "파이낸셜뉴스", "아시아경제", "헤럴드경제", "전자신문", "지디넷", "비즈워치",
    "더벨", "인포맥스", "뉴스1", "문화일보", "경향신문", "서울신문", "ytn", "비즈니스포스트", "디지털타임스", "한국경제tv", "mbn",
)
#: Parts of the names of first-tier outlets.
TIER1_OUTLETS = (
    "reuters", "bloomberg", "associated press", "ap news", "wall street journal", "wsj", "financial times", "cnbc", "the new york times", "barron",
    "marketwatch", "forbes", "yonhap", "연합뉴스", "한국경제", "매일경제", "조선일보", "중앙일보", "동아일보", "한겨레", "jtbc", "sbs", "kbs", "mbc",
    "뉴시스", "머니투데이",
)
