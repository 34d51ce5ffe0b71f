"""Regular expressions and label constants that results depend on."""

# Sentiment labels.
POSITIVE = "POSITIVE"
NEGATIVE = "NEGATIVE"
NEUTRAL = "NEUTRAL"
DISTRESS = "NEGATIVE-DISTRESS"
UNCERTAIN = "UNCERTAIN"
LABELS = [POSITIVE, NEGATIVE, NEUTRAL, DISTRESS, UNCERTAIN]

# Characters that count as white space and as word characters in the results.
# Those up to U+00FF are listed one by one, which Java turns into a bit set.
LATIN_SPACES = "\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0"
WIDE_SPACES = "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE_CHARS = LATIN_SPACES + WIDE_SPACES
WORD_CHARS = "\\p{L}\\p{N}_"

# Text normalisation.
RT_PREFIX = f"(?iu)^(?:RT|轉發|轉貼|分享):?[{SPACE_CHARS}]*"
URL = f"https?://[^{SPACE_CHARS}]+|www\\.[^{SPACE_CHARS}]+"
MENTION = f"[@＠][{WORD_CHARS}一-鿿]+"
REPEATED_MARK = "([!?。！？.])\\1{2,}"

# Scripts.
CJK = "[一-鿿]"
TRADITIONAL = "[颱這個們麼說發點時間實國灣為來]"
CJK_IN_SAMPLES = "[㐀-鿿]"
TRADITIONAL_IN_SAMPLES = "[颱這個們麼說發點時間實國灣]"

# Shapes of profile samples.
DATETIME_LIKE = "^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}([ T]\\d{1,2}:\\d{2})?"
NUMERIC_LIKE = "^-?\\d+(\\.\\d+)?$"

# Tier 1 sentiment rules, Chinese.
DISTRESS_ZH = (
    "(救[命我]|急救|被困|受傷|失蹤|危險|危急|崩潰|絕望|快不行|撐不住|快死|"
    "活不下去|快淹|快倒|119打不|打不通|求救|求援|求助|求求|拜託.*幫|幫幫忙)"
)
SARCASM_ZH = "(感謝.*(政府|官員|長官)|英明|偉大的(?:政府|決策)|呵呵.*(政府|官員)|果然.*厲害)"
NEGATIVE_RHETORIC_ZH = (
    "(誰[來要負]責|誰賠|怎麼[會還能]這樣|氣死人?|看[看一]下結果|當初.*現在|"
    "預算被[刪砍]|經費被[刪砍]|砍預算|砍經費|根本(?:不|沒|是個)|"
    "還在[等睡]|又(?:是|來)|早就說|早就警告)"
)
POSITIVE_RHETORIC_ZH = "(終於|總算|還好|幸好|多虧|要不是|多謝)"
ANNOUNCEMENT_ZH = (
    f"^[{SPACE_CHARS}]*[【\\[](?:[^】\\]]{{0,15}})"
    "(?:政府|市府|縣府|公所|新聞|快訊|直播|現場|公告|通知|警報|氣象|消防|警察)"
    "[^】\\]]{0,15}[】\\]]"
)

# Tier 1 sentiment rules, English.
DISTRESS_EN = "(?iU)\\b(help me|trapped|injured|missing|critical|dying|can't survive|emergency|sos)\\b"
SARCASM_EN = (
    f"(?i)(thanks?[{SPACE_CHARS}]+(?:government|gov|officials),?[{SPACE_CHARS}]+very"
    f"|so[{SPACE_CHARS}]+much[{SPACE_CHARS}]+for)"
)
