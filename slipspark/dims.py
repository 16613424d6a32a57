"""Fixed values of the bet language and of the draw."""

from __future__ import annotations

# The draw has numbers 1..49; number n belongs to zodiac (n - 1) mod 12 of this sequence.
MAX_NUMBER = 49
ZODIAC_ORDER = "马蛇龙兔虎牛鼠猪狗鸡猴羊"

# The plays that can be priced, as (numbers per combination, odds).
PLAYS = {"二中二": (2, 65), "三中三": (3, 200), "复四三": (3, 200)}
STRAIGHT_ODDS = 47
UNPRICED_PLAY = "二中三"
ZODIAC_POOL_PLAY = "复四三"

# Bet modes and their order.
MODES = ("pingma", "lianma", "fushi")
MODE_LABELS = {"pingma": "平码", "lianma": "连码", "fushi": "复式"}

# Words around an amount.
AMOUNT_WORDS = ("各下", "各押", "各买", "各", "下", "押", "买")
PER_GROUP_WORDS = ("每组", "各组", "一组", "每一组", "各一组", "出", "组", "各", "下", "押", "买")

# Status texts.
EMPTY_STATUS = {
    "pingma": "未解析到有效平码投注，支持：18..06..12/250 或 狗20",
    "lianma": "未解析到有效连码投注，支持：46.47 换行 5.9二中二出50",
    "fushi": "未解析到有效复式投注，支持：复试二中二各20，然后下一行填号码",
}
EMPTY_STATUS_ALL = "未解析到有效投注"
NO_WINNERS = "暂无中奖用户"

# Chinese digits by value; 两 also means 2.
CN_DIGITS = "零一二三四五六七八九"

# Cell layout as fractions of image width and height.
LAYOUT = {
    "tableX": 0.205,
    "tableY": 0.145,
    "groupWidth": 0.186,
    "numberColumnWidth": 0.039,
    "rowHeight": 0.067,
    "paddingX": 0.012,
    "paddingY": 0.014,
    "sourceWidthPaddingMultiplier": 2.5,
    "sourceHeightPaddingMultiplier": 1.6,
}

# Thresholds of the two recognition passes.
FAST_CONFIDENCE = 0.95
VERIFY_CONFIDENCE = 0.55
REPORT_CONFIDENCE = 0.85
CELL_MARGIN = 6
MAX_CELL_AMOUNT = 9999
LINE_BAND = 12
LINE_GAP = 14

# Request admission and draw polling.
ADMIT_MAX = 20
ADMIT_WINDOW_MS = 60_000
POLL_INTERVAL = "60 seconds"
