"""Values that results depend on. All are defaults; every operator takes its own.

Fixed values: they must equal the ledger's and the searchers' own for the results to match.
"""

# Ledger columns, categories and rules.
HEADERS = ["카드명", "일자", "가맹점", "금액", "분류"]
CATEGORIES = ["식비", "카페/간식", "교통", "쇼핑", "통신", "의료", "문화/여가", "교육", "주거/공과금", "기타"]
CATEGORY_RULES = [
    (["씨유", "이마트24", "GS25", "KFC", "지에스 더프레시", "노랑냉장고"], "카페/간식"),
    (["교육", "학원", "스터디", "더지니어스아라"], "교육"),
    (["홈플러스", "하나로마트", "트레이더스", "농협성남", "(주)이마트", "롯데마트"], "식비"),
]
EXCLUDED_MERCHANTS = ["후불무승인_", "KT통신요금자동납부-991613", "KCP-성남시청", "KT 통신요금 기본할인", "KT 통신요금 추가할인"]
PERSONAL_CARDS = ["현대카드"]
SUBTOTAL_SUFFIX = " 소계"
GRAND_TOTAL = "전체 합계"
DEFAULT_TAB = "시트1"
TRANSACTION_KEYS = ["일자", "가맹점", "금액", "분류"]

# Files accepted per card.
CARD_EXTENSIONS = {"BC": [".pdf", ".xlsx", ".xls"], "SHINHAN": [".pdf", ".html", ".htm"], "HYUNDAI": [".html", ".htm"], "SAMSUNG": [".html", ".htm"]}

# Patterns of tokens, camel pieces, file names' months, pagers and JavaScript function heads.
TOKEN_RUNS = "[A-Za-z0-9]+|[가-힣]+"
CAMEL_PIECES = "[A-Z]+(?=[A-Z]|$)|[A-Z]?[a-z]+|[0-9]+"
MONTH = r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(?:\d{2})?(?!\d)"
PAGER = r"현재페이지\s*(\d+)\s*/\s*전체페이지\s*(\d+)"
SCRIPT_NAME = r"[A-Za-z_$][\w$]*"
SCRIPT_FUNCTION = rf"function\s+({SCRIPT_NAME})\s*\(([^)]*)\)"
SCRIPT_ARROW = rf"(?:const|let|var)\s+({SCRIPT_NAME})\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"
COMMENT_STARTS = ["//", "*", "/*"]

# How results are shown.
VIA_SHORT = {"seed": "씨앗", "CALLS": "→호출", "CALLED_BY": "←피호출", "SIBLING": "·형제", "CONTAINS": "·포함", "CONTAINED_BY": "·상위", "INHERITS": "·상속", "INHERITED_BY": "·하위"}

VIA_LONG = {"seed": "씨앗(어휘 매칭)", "CALLS": "→ 호출 하류", "CALLED_BY": "← 호출 상류", "SIBLING": "· 같은 파일/클래스", "CONTAINS": "· 포함", "CONTAINED_BY": "· 상위", "INHERITS": "· 상속", "INHERITED_BY": "· 하위클래스"}

# What an extraction engine is asked, with the card's name and the categories.
INSTRUCTION = """아래는 {card} 신용카드 명세서입니다.
이 안에서 실제 결제 거래 내역만 골라 JSON으로 반환하세요.

규칙:
- 합계/소계/카드번호/유효기간 등 거래가 아닌 줄은 제외합니다.
- 취소·환불 거래는 금액을 음수로 표기합니다.
- 가맹점명은 원문 표기를 그대로 사용합니다 (임의로 축약하지 않음).
- 분류는 반드시 다음 중 하나로 선택합니다: {categories}
"""

# Retrieval.
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60
KINDS = ["module", "function", "class", "method"]
KIND_SEED_WEIGHT = {"function": 1.0, "method": 1.0, "class": 0.85, "module": 0.3}
EDGE_WEIGHT = {"CALLS": 1.0, "CALLED_BY": 0.9, "SIBLING": 0.45, "CONTAINS": 0.6, "CONTAINED_BY": 0.5, "INHERITS": 0.7, "INHERITED_BY": 0.7}
DEFAULT_EDGE_WEIGHT, SCORE_FLOOR = 0.3, 1e-4
PAGERANK_DAMPING, PAGERANK_ROUNDS = 0.85, 40
