"""Word lists and weights that results depend on, in their natural order."""

from __future__ import annotations


# Traditional Chinese positive terms.
ZH_TW_POSITIVE = {
    "感謝": 1, "謝謝": 1, "感恩": 1, "感激": 1, "感激不盡": 2, "銘感": 1, "謝天謝地": 2, "幫忙": 1, "互助": 1, "援助": 1, "救援": 1, "救助": 1,
    "救命之恩": 2, "守望相助": 2, "團結": 1, "凝聚": 1, "齊心": 1, "齊心協力": 2, "同心": 1, "合作": 1, "安全": 1, "安心": 1, "放心": 1, "平安": 1,
    "無恙": 1, "守護": 1, "保護": 1, "加油": 1, "振作": 1, "鼓勵": 1, "支持": 1, "希望": 1, "信心": 1, "堅強": 1, "挺住": 1, "溫暖": 1,
    "感動": 1, "暖心": 1, "安慰": 1, "順利": 1, "順遂": 1, "成功": 1, "完成": 1, "恢復": 1, "重建": 1, "復原": 1, "圓滿": 1, "幸運": 1,
    "幸福": 1, "開心": 1, "高興": 1, "滿意": 1, "棒": 1, "讚": 1, "太好了": 2, "真的很棒": 2, "真不錯": 1, "真了不起": 2,
}

# Traditional Chinese negative terms.
ZH_TW_NEGATIVE = {
    "批評": -1, "抗議": -1, "失望": -1, "不滿": -1, "抱怨": -1, "失職": -2, "失能": -2, "瀆職": -2, "推諉": -1, "卸責": -2, "官僚": -1,
    "甩鍋": -1, "隱瞞": -1, "敷衍": -1, "無能": -2, "無作為": -2, "背叛": -2, "拋棄": -2, "辜負": -1, "騙人": -2, "說謊": -1, "假的": -1,
    "造假": -2, "不可接受": -2, "可惡": -2, "可恥": -2, "生氣": -1, "憤怒": -2, "氣憤": -2, "怒": -1, "怒火": -1, "氣死人": -2, "太慢": -1,
    "太差": -2, "有夠爛": -2, "糟糕": -1, "慘": -1, "慘了": -1, "慘況": -1, "慘重": -2, "慘烈": -2, "災難": -2, "災情": -1, "失敗": -1,
    "難過": -1, "傷心": -1, "悲傷": -1, "悲痛": -2, "哀傷": -1, "哭": -1, "淚": -1, "心碎": -2, "絕望": -2, "崩潰": -2, "痛苦": -2,
    "辛苦": -1, "恐慌": -2, "恐懼": -2, "害怕": -1, "擔心": -1, "擔憂": -1, "焦慮": -1, "不安": -1, "慌張": -1, "危險": -1, "危急": -2,
    "危機": -1, "警戒": -1, "警報": -1, "混亂": -1, "失控": -2, "死亡": -2, "罹難": -2, "遇難": -2, "喪生": -2, "受傷": -1, "傷亡": -2,
    "失蹤": -2, "損失": -1, "損毀": -1, "損壞": -1, "毀": -1, "毀損": -1, "淹沒": -1, "倒塌": -2, "停電": -1, "斷電": -1, "缺水": -1,
    "斷水": -1, "斷訊": -1, "中斷": -1, "短缺": -1, "搶不到": -1, "買不到": -1, "延誤": -1, "延遲": -1, "取消": -1, "被忽略": -1, "被遺忘": -1,
    "沒人理": -1, "打不通": -1, "不行": -1, "不該": -1, "不應該": -1, "太誇張": -1, "離譜": -1,
}

# Traditional Chinese intensifiers (weight 0: listed, without effect on the score) and negators.
ZH_TW_INTENSIFIERS = {"非常": 0, "真的": 0, "真是": 0, "實在": 0, "超": 0, "太": 0, "極": 0, "很": 0}
ZH_TW_NEGATORS = ["不", "沒", "別", "無", "未"]

# English positive terms.
EN_POSITIVE = {
    "thanks": 1, "thank": 1, "thankful": 1, "grateful": 1, "appreciate": 1, "safe": 1, "secure": 1, "reassured": 1,
    "help": 1, "helping": 1, "helped": 1, "rescued": 2, "supported": 1, "community": 1, "together": 1, "unite": 1,
    "united": 1, "great": 1, "excellent": 2, "amazing": 2, "wonderful": 2, "hopeful": 1, "recovered": 1,
    "recovering": 1, "rebuilding": 1, "strong": 1, "resilient": 1,
}

# English negative terms.
EN_NEGATIVE = {
    "angry": -1, "furious": -2, "outraged": -2, "frustrated": -1, "disappointed": -1, "terrible": -2, "awful": -2,
    "disaster": -2, "disastrous": -2, "failed": -1, "failure": -1, "chaos": -1, "broken": -1, "danger": -1,
    "dangerous": -1, "missing": -1, "trapped": -1, "stranded": -1, "death": -2, "dead": -2, "killed": -2,
    "injured": -1, "casualties": -2, "destroyed": -2, "outage": -1, "shortage": -1, "delay": -1, "delayed": -1,
    "ignored": -1, "neglected": -1, "scared": -1, "worried": -1, "anxious": -1, "panic": -2, "helpless": -2,
    "hopeless": -2, "desperate": -2, "crying": -1, "unacceptable": -2, "incompetent": -2, "betrayed": -2,
    "lying": -1, "liar": -2,
}

# English intensifiers (weight 0) and negators.
EN_INTENSIFIERS = {"very": 0, "really": 0, "extremely": 0, "so": 0, "too": 0}
EN_NEGATORS = ["not", "no", "never", "without", "n't"]

# Stopwords by language tag; every zh-* tag also takes those of zh (none).
STOPWORDS = {
    "zh-TW": ["的", "了", "是", "在", "和", "也", "都", "就", "要"],
    "zh-CN": ["的", "了", "是", "在", "和", "也", "都", "就", "要"],
    "zh": [],
    "en": [],
    "ja": ["の", "に", "は", "を", "が", "と"],
}

# Words a zh-TW dictionary must keep whole.
ZH_TW_EXTRA_WORDS = ["颱風", "蘇花改", "紓困"]

# Author values that mean an automated account.
BOT_LABELS = ["疑似機器人", "可疑機器人", "机器人", "suspected_bot", "bot"]

# Author values drawn as bots in the category chart.
CHART_BOT_LABELS = ["疑似機器人", "suspected_bot", "bot"]

# Text that a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Name hints for low-cardinality columns.
PLATFORM_HINTS = ["platform", "source", "平台", "channel"]
AUTHOR_HINTS = ["author", "user", "帳號", "type", "role"]

# Sarcasm seeds (pattern, polarity flip, confidence) by language.
SARCASM_SEEDS = {
    "zh-TW": [("感謝(政府|官員)", "positive_to_negative", 0.65)],
    "en": [("(thanks|wow|great), (government|gov)", "positive_to_negative", 0.55)],
}

# Frequent words by language, none of them in two lists.
FREQUENT_WORDS = {
    "de": "der die das und ist nicht ein eine einen mit für auf dem den von zu sich im wir ich auch noch aber oder".split(),
    "en": "the and of to is are with this that for have you we it be by at from they would their our has been".split(),
    "es": "el los las y que por con para como más pero su sus una del muy está hay todo cuando sin ya lo".split(),
    "fr": "le les et est dans pour qui pas sur avec vous nous ce au du des cette mais sont plus être il elle ne".split(),
    "nl": "het een van niet dat op voor zijn aan ook maar naar wij ik bij uit nog wel deze hebben wordt geen".split(),
}
