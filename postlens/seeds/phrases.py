"""Wording of the report and of the findings, in English and Traditional Chinese.

Any zh* tag uses zh-TW, everything else English. Texts with ``%`` are templates
of ``format_string``; what fills them is named beside their use in brief.py.
"""

from __future__ import annotations

# Section headings and field labels of the zh-TW report.
FIXED_ZH = {
    "section_1": "第一節 — 主要發現",
    "section_2": "第二節 — 情感分布（按主題分列，禁止整體加總）",
    "section_3": "第三節 — 主題 / 敘事登錄表",
    "section_4": "第四節 — 放大行為指標",
    "section_5": "第五節 — 分析限制",
    "section_6": "第六節 — 後續建議",
    "bluf": "BLUF",
    "confidence": "信心等級",
    "limitation": "限制",
}

ZH = FIXED_ZH | {
    "title": "貼文分析報告：%s",
    "about": "批次 %s，製作日 %s，來源 %s，共 %,d 則貼文",
    "columns_used": "本次用到的欄位類別：%s",
    "draft": "此為初稿，發布前須由另一位分析師覆核。",
    "no_findings": "這批資料沒有任何項目達到列為發現的標準。",
    "evidence": "依據",
    "recommend": "下一步",
    "no_matrix": "沒有可統計的主題，因此沒有分布表。",
    "matrix_head": "| 主題 | 則數 | 正面 | 負面 | 求助 | 中性 |",
    "matrix_note": "表中各列只能單獨解讀；跨主題的平均值會掩蓋差異，請勿引用。",
    "story": "**%s**（%,d 則）：%s",
    "story_roles": "發話者：%s；期待讀者：%s",
    "engagement_line": "互動最高的 5%% 貼文占全部互動的 %s%%",
    "author_line": "由單一作者類型主導的主題數：%s",
    "burst_line": "每小時則數超過平均加 %2$s 個標準差的時段數：%1$s",
    "copies_line": "文字與其他貼文完全相同的比例：%s%%",
    "signals_line": "協同檢核表 %2$s 項中有 %1$s 項成立，判定為%3$s",
    "no_ts": "缺少發文時間，時段與爆量無從檢查。",
    "no_engagement": "缺少互動數，無法看出聲量是否集中。",
    "no_author": "缺少作者類型，無法看出發言是否集中於某類帳號。",
    "gap": "欄位 %s 有 %s%% 的貼文沒有值，相關數字只反映其餘貼文。",
    "standing_1": "情緒由規則與詞表判定，暗諷與需要上下文的語句容易判錯。",
    "standing_2": "主題由網格分群得出，格子大小與最小主題的設定不同，主題數也會不同。",
    "standing_3": "放大行為的各項數字都是間接跡象；沒有帳號之間的關係與歷史，不足以認定有人串連。",
    "standing_4": "某主題情緒偏高不代表它造成了什麼；推薦機制同樣會推高互動。",
    "title_neg": "負面最集中的主題：%s",
    "title_pos": "正面最集中的主題：%s",
    "title_amp": "出現放大行為的跡象（%s）",
    "bluf_neg": "「%s」共 %,d 則，其中 %.1f%% 帶有負面或求助情緒，為各主題之冠。",
    "bluf_pos": "「%s」共 %,d 則，其中 %.1f%% 為正面，高於其他主題。",
    "bluf_amp": "檢核表 %2$s 項中 %1$s 項成立；前 5%% 貼文占互動 %3$s%%，重複文字占 %4$s%%。",
    "evidence_topic": "分布表中該主題的占比為 %.1f%%。敘事：%s",
    "evidence_amp": "逐項結果：%s",
    "reason_neg": "占比直接由標記算出，但敘事內容還沒有人確認。",
    "reason_pos": "占比可靠，不過為何正面仍待人工閱讀原文。",
    "lim_neg_1": "詞表認不出的語氣會讓占比偏高或偏低。",
    "lim_neg_2": "若主題合併或拆分，名次可能改變。",
    "lim_pos_1": "沒被規則抓到的反話會被算成正面。",
    "lim_pos_2": "口號式標籤會拉高正面占比。",
    "lim_amp_1": "只看貼文本身，看不到帳號的追蹤關係與過去行為。",
    "lim_amp_2": "無法比對同一人在不同平台的帳號。",
    "rec_neg": "優先追蹤「%s」；引用前先確認發話者（%s）並讀過原文。",
    "rec_pos": "若要正面回應，可從「%s」挑選原文，逐則確認後再用。",
    "rec_amp": "把成立的項目交給平台方查核；證據補齊之前不要對外指稱有人操作。",
    "end": "報告結束",
    "needs_human": "待分析師填寫",
    "no_narrative": "尚無敘事",
    "narrative": "「%s」的貼文常提到「%s」；誰在說、要求什麼，須由分析師讀過樣本後填寫。",
    "HIGH": "高",
    "MODERATE": "中",
    "LOW": "低",
}

EN = {
    "section_1": "1. What stands out",
    "section_2": "2. Sentiment by topic",
    "section_3": "3. Topics and their stories",
    "section_4": "4. Signs of amplification",
    "section_5": "5. What the data cannot show",
    "section_6": "6. What to do next",
    "bluf": "In short",
    "confidence": "Confidence",
    "limitation": "Caveat",
    "title": "Post analysis: %s",
    "about": "Run %s of %s over %s with %,d posts",
    "columns_used": "Kinds of columns found: %s",
    "draft": "This is a draft. A second analyst has to check it before anyone outside reads it.",
    "no_findings": "Nothing in these posts was strong enough to report.",
    "evidence": "Based on",
    "recommend": "Next step",
    "no_matrix": "No topic could be counted, so there is no table.",
    "matrix_head": "| topic | posts | positive | negative | distress | neutral |",
    "matrix_note": "Read each row by itself; an average over topics hides the differences between them.",
    "story": "**%s** (%,d posts): %s",
    "story_roles": "Who speaks: %s; what readers should do: %s",
    "engagement_line": "Share of all engagement held by the top 5%% of posts: %s%%",
    "author_line": "Topics in which one kind of author dominates: %s",
    "burst_line": "Hours more than %2$s standard deviations above the mean: %1$s",
    "copies_line": "Posts whose text occurs more than once: %s%%",
    "signals_line": "Checklist: %s of %s items hold, which counts as %s",
    "no_ts": "Posts carry no time, so rhythm and bursts were not examined.",
    "no_engagement": "Posts carry no engagement figure, so its concentration was not examined.",
    "no_author": "Posts carry no kind of author, so dominance by one kind was not examined.",
    "gap": "Column %s is empty on %s%% of the posts; figures from it describe the others only.",
    "standing_1": "Sentiment comes from rules and word lists, which miss tone that needs context.",
    "standing_2": "Topics come from a grid over reduced vectors; another grid or least size gives other topics.",
    "standing_3": "Signs of amplification are indirect. Without ties between accounts they prove no coordination.",
    "standing_4": "A topic's mood says nothing about causes; ranking by a platform raises engagement too.",
    "title_neg": "Most negative topic: %s",
    "title_pos": "Most positive topic: %s",
    "title_amp": "Posts look amplified (%s)",
    "bluf_neg": "Of all topics, '%s' (%,d posts) has the largest share of negative or distressed posts, %.1f%%.",
    "bluf_pos": "Of all topics, '%s' (%,d posts) has the largest share of positive posts, %.1f%%.",
    "bluf_amp": "%s of %s checks hold; the top 5%% of posts draw %s%% of engagement and %s%% of posts repeat a text.",
    "evidence_topic": "The topic's row in the sentiment table shows %.1f%%. Story: %s",
    "evidence_amp": "Checks one by one: %s",
    "reason_neg": "The share follows from the labels, but nobody has confirmed the story behind it yet.",
    "reason_pos": "The share is solid; why the mood is good has to be read from the posts.",
    "lim_neg_1": "Irony and wording outside the word list move this share up or down.",
    "lim_neg_2": "Splitting or joining topics may put another one first.",
    "lim_pos_1": "Mockery that no rule recognises counts as praise.",
    "lim_pos_2": "Slogans in hashtags lift the positive share.",
    "lim_amp_1": "Only the posts were seen, not who follows whom nor what accounts did before.",
    "lim_amp_2": "Accounts of one person on several platforms cannot be matched.",
    "rec_neg": "Follow '%s' first; before quoting it, find out who speaks (%s) and read the posts.",
    "rec_pos": "For a friendly answer, pick posts from '%s' one by one and check each.",
    "rec_amp": "Hand the checks that hold to the platform's own team, and accuse nobody until accounts have been examined.",
    "end": "End of the report",
    "needs_human": "left to the analyst",
    "no_narrative": "no story yet",
    "narrative": "Posts on '%s' often mention '%s'; an analyst has to read samples to say who wants what.",
    "HIGH": "high",
    "MODERATE": "middling",
    "LOW": "low",
}


def phrase(language: str | None, key: str) -> str:
    return (ZH if (language or "").startswith("zh") else EN)[key]
