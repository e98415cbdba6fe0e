"""Word lists, patterns, limits and tables the results depend on.

Every constant in this file is a fixed value that has to be equal to the published
behaviour for the results to be right; none of them is derived.
"""

# fixed values: outcomes and fallback reasons -------------------------------------------
FALLBACK_REASONS = ("no_evidence", "verification_failed", "deadline", "out_of_scope", "tool_failure")
ACTIONABLE_REASONS = ("no_evidence", "verification_failed", "deadline")
COUNTED_REASONS = ("no_evidence", "verification_failed")
OUT_OF_SCOPE = "out_of_scope"
WARN_MIN_TURNS, WARN_MIN_BAD, WARN_RATE, CRITICAL_RATE = 20, 4, 0.20, 0.35
RECENT_FALLBACKS = 60
QUERY_PREVIEW = 200

# fixed values: masks, applied in this order ----------------------------------------------
MASK_EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
MASK_MOBILE = r"(?<!\d)01\d-?\d{3,4}-?\d{4}(?!\d)"
MASK_ID = r"(?<!\d)\d{8,10}(?!\d)"
MASK_NAME = r"(제\s*이름은\s*)[가-힣]{2,4}"

# fixed values: screening of anonymous texts -----------------------------------------------
SCREEN_URL = r"https?://|www\.|\.(com|net|kr|io|me|ly)\b|open\.kakao"
SCREEN_CONTACT = (
    r"\d{2,3}[-.\s]?\d{3,4}[-.\s]?\d{4}|[\w.+-]+@[\w-]+\.[\w.]+|카톡\s*(아이디|id)|인스타|@\w{3,}"
)
SCREEN_PROFANITY = r"시발|씨발|ㅅㅂ|병신|ㅂㅅ|개새|좆|존나|닥쳐|꺼져|미친놈|미친년"
SCREEN_AD = r"할인|쿠폰|이벤트\s*참여|광고|홍보합니다|가입\s*하세요|문의\s*주세요|판매|구매\s*링크"
SCREEN_INJECTION = (
    r"(이전|위의?|앞의?)\s*(지시|명령|프롬프트)[^.]{0,20}(무시|잊)|system\s*prompt|ignore\s+(all|previous)"
)
SCREEN_OUT_OF_SCOPE = (
    r"장학|등록금|휴학|복학|졸업\s*(요건|학점|사정)|학칙|수강\s*신청|성적\s*(정정|처리)"
)
SAFETY = r"엘리베이터|장애|휠체어|야간|밤길|비상|대피|소화기|AED|응급|심폐"
MIN_TIP_CHARS = 10

# fixed values: crawl page classes -----------------------------------------------------------
EXCLUDE_WORDS = (
    "입찰", "채용", "인사", "공사", "보도", "동정", "발전기금", "기부", "교직원", "조직", "직원",
    "감사", "예결산", "회의록", "정보공개", "언론", "총장실", "법인",
)

# fixed values: tip rules ---------------------------------------------------------------------
MIN_VOTES, MIN_CONFIRM_RATIO, MIN_PUBLIC_HOURS, MAX_NET_SHARE = 3, 0.6, 24, 0.5
CONTEST_RATIO, FLAGS_TO_HIDE, FLAG_NETS_TO_HIDE = 0.5, 3, 3
FRESH_DAYS, ADMIN_FRESH_DAYS, FRESH_CONFIRMS = 30, 180, 2
RECHECK_DAYS = {"student_approved": 30, "approved": 180}
TIP_PER_NET_DAY, REPORT_PER_NET_DAY, SUBMIT_GLOBAL_DAY = 3, 5, 100
VOTES_PER_TOKEN_DAY, VOTES_PER_NET_DAY = 30, 2000

# fixed values: lifetimes in hours ---------------------------------------------------------------
TTL_HOURS = {
    "quota": 72, "text": 2160, "vote": 4320, "turn": 2160, "thread": 24, "client_error": 336,
    "verified_unanswered": 720,
}

# fixed values: citation verification ----------------------------------------------------------
MIN_QUOTE_CHARS = 6
UNIT_NUMBER = (
    r"\d+(?:[.,]\d+)?\s*(?:학점|년|월|일|주일?|개월|학기|회|번|차례|%|퍼센트|원|만\s*원|시간|분|명|과목)"
)
CITATION_MARK = r"제\s*\d+\s*(?:조(?:\s*의\s*\d+)?|항|호|장|절|편)"
REPORT_VALUE = r"(\d+(?:[.,]\d+)?)\s*(학점|만\s*원|원|일|시간|주|개월|%|퍼센트|명|회|층|분)"
ISO_LIKE_DATE = r"(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})"
DOTTED_DAY = r"(?<![\d.])(\d{1,2})\.\s*(\d{1,2})\.(?!\d)"
TABLE_PREFIX = "[표]"
TABLE_PAIR = r"([^:·|\]]+?)\s*:\s*([￦₩]?)\s*(\d+(?:[.,]\d+)*)\s*(?=·|$)"
TABLE_UNITS = (
    ("학점", "학점"), ("개월", "개월"), ("학기", "학기"), ("년", "년"), ("시간", "시간"),
    ("정원", "명"), ("인원", "명"), ("금액", "원"), ("등록금", "원"), ("장학금", "원"),
    ("요금", "원"), ("수수료", "원"), ("비율", "%"), ("횟수", "회"),
)
NEGATION = ("할 수 없", "하지 아니", "불가")
OBLIGATION, PERMISSION = "하여야", "할 수 있"
RISKY = (
    "아니", "않", "없", "못", "불가", "제외", "금지", "그러하지", "단,", "다만", "하여야", "할 수",
    "제한", "허용", "허가", "인정",
)
POSITIVE = r"할\s*수\s*있|(?<!불)가능(합|하|$)"
NEGATIVE = r"할\s*수\s*없|불가능|불가|가능하지\s*않|허용되지\s*않|안\s*된다"
NOT_FOUND = (
    r"찾지\s*못|확인(할|되)\s*수\s*없|확인되지\s*않|정보가\s*없|내용이\s*없|안내되어\s*있지\s*않"
    r"|알\s*수\s*없|나와\s*있지\s*않"
)
DELEGATED = (
    r"(따로|별도로)\s*정하여\s*(고지|공고|공지)"
    r"|(기간|일정|인원|요금|금액|방법|절차|기준|시간|장소)[^.。]{0,20}(공고|고지|공지)(한다|하여야)"
)

# fixed values: needs and resolution --------------------------------------------------------------
NEED_KINDS = {
    "eligibility_or_limit": ("rule",),
    "current_deadline": ("rule",),
    "procedure_and_contact": ("guide", "rule"),
    "location": ("guide",),
}
NEED_PRIORITY = {
    "eligibility_or_limit": (("article",), ("guide",)),
    "current_deadline": (("calendar", "notice"), ("article",)),
    "procedure_and_contact": (("guide",), ("article",)),
    "menu": (("menu",), ()),
    "location": (("place",), ("tip",)),
}
CHANGE_MARK = r"변경|연장|정정|수정"
OVERRIDE_TEMPLATE = "학사일정 이후 게시된 공지「%s」에 변경 내용이 있어 공지 기준으로 안내합니다."
MISMATCH_TEMPLATE = (
    "학사일정과 공지「%s」의 %s 기간이 서로 다릅니다. 두 출처를 모두 확인하시고 "
    "정확한 기간은 담당 부서에 문의해 주세요."
)
CONTACT_QUESTION = r"전화|연락처|번호|팩스|사무실"
SCHOLARSHIP_WORDS, GENERAL_WORDS = ("장학",), ("일반공지", "행사", "채용")
GENERIC_TOPIC_WORDS = ("장학", "학사", "일반", "주요", "학교", "이번", "주", "최근", "새", "사항", "소식", "안내")
RELATIVE_DAYS = (("모레", 2), ("내일", 1), ("어제", -1), ("오늘", 0))
WEEK_SHIFT = (("지난주", -7), ("저번주", -7), ("지난 주", -7), ("다음주", 7), ("다음 주", 7))
WEEKDAYS = ("월요일", "화요일", "수요일", "목요일", "금요일", "토요일", "일요일")

# fixed values: follow-up questions --------------------------------------------------------------
FOLLOW_UP_BLOCK = r"학번|주민|전화번호|연락처를 알려|비밀번호|계좌|주식|코인|날씨|연애"
FOLLOW_UP_MAX, FOLLOW_UP_LEN = 3, 40

# fixed values: evaluation -------------------------------------------------------------------------
TYPE_CRITERIA = {
    "rule": ("retrieval", "key_facts", "no_errors", "citation"),
    "procedure": ("retrieval", "key_facts", "no_errors", "citation", "action"),
    "notice": ("key_facts", "no_errors", "citation"),
    "calendar": ("key_facts", "no_errors", "citation"),
    "menu": ("key_facts", "no_errors", "citation"),
    "location": ("key_facts", "no_errors", "citation"),
    "oos": ("oos_fallback",),
}
QUOTA_EXCEEDED = "quota_exceeded"
EVAL_MAX_ITEMS, HISTORY_KEEP = 150, 30

# fixed values: regulation text ----------------------------------------------------------------------
ARTICLE_HEAD = r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?\s*"
CHAPTER_HEAD = r"^제\s*\d+\s*장(?:\s|$)"
SECTION_HEAD = r"^제\s*\d+\s*절(?:\s|$)"
ADDENDA_HEAD = r"^부\s*칙"
APPENDIX_HEAD = r"^[\(\[]?별(?:표|지)\s*\d*"
DELETED = r"<\s*삭\s*제\s*>|^\s*삭\s*제(?=\s|<|$)"
NOTE = r"<\s*(?:개정|본조신설|전문개정|제목개정)[^>]*>"
NOTE_LINE = r"^[\[<]\s*(?:본조신설|종전|전문개정|제목개정|개정)[^\]>]*[\]>]$"
DOT_DATE = r"(?<!\d)(\d{2,4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})(?:\s*\.)?"
KOREAN_DATE = r"(?<!\d)(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
TABLE_APPENDIX_HEAD = r"^[\(\[]?\s*별\s*표\s*(\d+)(?:\s*[-의]\s*(\d+))?"
TABLE_TOKEN = r"<\s*표\s*>"
TABLE_UNREADABLE = "[표 — 원문 참조]"
APPENDIX_SUBHEAD = r"^(?:\d{4}\s*(?:학년도|년도)|\d{1,2}\.\s)"
CHUNK_OVER, CHUNK_SIZE, WEB_CHUNK, NOTICE_CHUNK, UPLOAD_CHUNK = 2000, 1500, 1200, 1500, 1500
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"

# fixed values: periods in titles -----------------------------------------------------------------------
PERIOD_DATE = (
    r"(?:(20\d{2})\s*(?:[./-]|년)\s*)?(\d{1,2})\s*(?:[./-]|월)\s*(\d{1,2})\s*(?:일|\.)?(?:\s*\([월화수목금토일]\))?"
)
RANGE_MARK = "[~∼～]"
DEADLINE_MARK = "(?:까지|마감)"
MAX_PERIOD_DAYS = 60

# fixed values: phone numbers ---------------------------------------------------------------------------
LOCAL_AREA, LOCAL_OFFICE = "055", "249"
PHONE = r"\(?0\d{1,2}\)?[-\s]?\d{3,4}-\d{4}"
PHONE_TOKEN = r"(0505-\d{3}-\d{4}|0\d{1,2}-\d{3,4}-\d{4}|\d{3,4}-\d{4}|(?<![\d-])\d{4}(?![\d-]))(\(F\))?"
UNIT_MARKS = "￭¤▣■◆●"
PARENT_MARKS = "¤▣"

# fixed values: notice dates -------------------------------------------------------------------------------
NOTICE_DATE = (
    r"(?:(20\d{2})[.\-/])?(\d{1,2})[.\-/](\d{1,2})(?:\s*~\s*(?:(20\d{2})[.\-/])?(\d{1,2})[.\-/](\d{1,2}))?"
)
WEEK_TITLE_DATE = r"(\d{1,2})[./-](\d{1,2})(?:\s*~\s*(\d{1,2})[./-](\d{1,2}))?"
NOTICE_TOPICS = ("수강신청", "휴학", "복학", "등록", "졸업")
DATE_LABELS = ("행사일", "신청 기간", "신청 마감", "기간")

# fixed values: student page words -------------------------------------------------------------------
STUDENT_WORDS = (
    "학사", "수강", "성적", "시험", "휴학", "복학", "졸업", "전과", "등록금", "장학", "학생", "생활", "편의", "복지",
    "시설", "주차", "교통", "통학", "버스", "식당", "식단", "기숙", "생활관", "도서관", "증명", "보건", "상담", "취업",
    "진로", "동아리", "학자금", "외국인", "유학생", "캠퍼스", "안내",
)

# fixed values: telemetry ---------------------------------------------------------------------------------
ERROR_KINDS = ("js_error", "unhandled_rejection", "sse_disconnect", "map_load", "calendar_fetch")
ERROR_PAGES = ("chat", "tips", "calendar")
CLIENT_NOISE = r"ResizeObserver|^Script error\.?$"
EXTENSION_FILE = r"^(chrome|moz|safari(-web)?)-extension:"

# fixed values: event lists -----------------------------------------------------------------------------
SOON_DAYS, UPCOMING_LIMIT = 7, 12
SCAN_MAX_ATTEMPTS = 3
EVENT_LOOKBACK_DAYS, NOTICE_LOOKBACK_DAYS, EXPIRED_DAYS = 60, 90, 30
PLACEHOLDERS = ("♥", "-", "·")

RULE_OUT_OF_SCOPE = ("대학원",)
