"""Fixed values.

Results depend on every value in this file, so they are kept together and stated plainly:
word lists, label names, patterns, limits and output formats.  None of them is logic.
"""

# --- labels -----------------------------------------------------------------------------------
LABELS = ("positive", "negative", "neutral")
UNKNOWN = "unknown"

# --- white space as Python's str.strip() and \s see it (29 characters) ------------------------
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# the same set as a regex class body; both Java and RE2 read it
WS_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NON_WS = f"[^{WS_CLASS}]"

# --- text patterns ----------------------------------------------------------------------------
URL_ANYWHERE = rf"http{NON_WS}+|www[^\n]{NON_WS}+"
URL_WITH_SCHEME = rf"https?://{NON_WS}+"
MENTION = rf"@{NON_WS}+"
HASH_TOPIC = r"#([^#]+)#"
KEYCAP_EMOJI = r"[0-9#*]\x{FE0F}?\x{20E3}"
KEPT_CHARS = "0-9A-Za-z一-鿿"
CJK = "一-鿿"
CHINESE_SHARE = 0.2

# --- model replies ----------------------------------------------------------------------------
THINK_BLOCK = r"(?s)<think>.*?</think>"
LABEL_AND_SCORE = r"\b(positive|negative|neutral)\s*,\s*(0?\.[0-9]{2}|1\.00)\b"
# the number literals Python's float() reads, with optional underscores between digits
FLOAT_LITERAL = (
    r"^[+-]?("
    r"([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?"
    r"|(?i:nan|inf|infinity))$"
)
FAILED_PREFIX = "[翻译失败:"
FAILED_MESSAGE_CHARS = {"concurrent": 160, "serial": 120}

# --- null literals of a default CSV read ------------------------------------------------------
NULL_LITERALS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- default stop words -----------------------------------------------------------------------
CLOUD_STOP_WORDS = (
    "的", "了", "和", "是", "在", "就", "都", "而", "及", "与", "着", "或", "一个", "没有",
    "我们", "你们", "他们", "她们", "它们", "以及", "因此", "但是", "如果", "因为",
    "这", "那", "呢", "啊", "吗", "吧", "呀", "哦", "嗯", "哦哦", "哈哈", "哈哈哈",
    "自己", "还有", "而且", "这个", "那个", "这些", "那些", "什么", "怎么",
    "不是", "就是", "并且", "非常", "真的", "然后",
    "可以", "不会", "不能", "可能", "已经", "还是", "的话", "一下",
    "一下子", "一下儿", "比如", "比如说", "比如讲", "同时", "目前",
    "今天", "昨天", "明天", "现在", "正在", "所以",
)
TOPIC_STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "都", "一个", "上", "看", "好", "这",
)

# --- limits and formats -----------------------------------------------------------------------
CLOUD_TOP_N = 500
PREVIEW_TOP_N = 50
PREVIEW_ROWS = 5
TRANSLATED_SUFFIX = "_已翻译"
TOPIC_LINE = "主题 %d: %s"
METRIC_LINE = "主题数为%d时，Perplexity为:%s,Coherence Score为:%s"
METRIC_LINE_PATTERN = r"^主题数为(\d+)时，Perplexity为:([^,]+),Coherence Score为:(\S+)"

# --- topic model ------------------------------------------------------------------------------
TOPIC_COUNTS = tuple(range(3, 21))
LDA_SEED = 42
LDA_PASSES = 50
LDA_CHUNK = 800
LDA_WORKERS = 32
WORDS_PER_TOPIC_LINE = 15
COHERENCE_WINDOW = 110
COHERENCE_TOP_WORDS = 20
COHERENCE_EPSILON = 1e-12

# --- request options, by form of the request --------------------------------------------------
REQUEST_OPTIONS = {
    "local": {"stream": False},
    "remote": {"temperature": 0.0, "stream": False},
    "concurrent": {"stream": False, "options": {}},
    "serial": {"temperature": 0.2, "max_tokens": 512},
}
