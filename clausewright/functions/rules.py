"""Patterns, words and texts that the results depend on."""

#: White space of Unicode, as (?U)\\s has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What repeats is taken possessively, and runs of digits are entered at their first: time then goes with the length of a text.
STANDARD = r"(?<![A-Za-z])(GBJ|GB|JGJ|CJJ|DB(?U:\d){2}|T)(?U:\s)*+(/(?:(?U:\s)*+T)?)?(?U:\s)*+((?U:\d){2,5})(?:(?U:\s)*[-—–](?U:\s)*((?U:\d){4}))?"
#: What has the one spelling of a standard but for its space.
CLOSE_STANDARD = r"^(GBJ|GB|JGJ|CJJ|DB[0-9]{2})([0-9]{2,5}-[0-9]{4})\z"
#: What already has the one spelling of a standard, and of a number.
NORMAL_STANDARD, NORMAL_NUMBER = r"^(GBJ|GB|JGJ|CJJ|DB[0-9]{2})(/T)? [0-9]{2,5}-[0-9]{4}\z", r"^[0-9]+([.][0-9]+)+\z"
_NUMBER = r"\d{1,2}(?:\s*[.．]\s*\d{1,3}){1,3}"
#: A number behind 第, or before 条.
LABELLED = rf"(?U)(?:第\s*|(?={_NUMBER}(?:\s*[.．]\s*条)?\s*条))({_NUMBER})"
BARE = rf"(?U)(\d{{1,2}}(?:\s*[.．]\s*\d{{1,3}}){{1,3}})(?:\s*-\s*\d{{1,2}})?"
#: A lettered appendix; the letter ends its word.
LETTERED = r"(?U)附\s*[表录]\s*([A-Za-z])"
YEAR = r"(?U)\d{4}\s*年"
QUANTITY = r"(?U)(?<!\d)\d++(?:\.\d++)?\s*+(?:m|mm|cm|℃|%|kg|级|座|人|册|米|米²|米2)(?![.\d])"
SENTENCE_END = r"[。；;\n]"
#: The heading behind which a standard has explanations and no clauses.
BACK_MATTER = r"(?U)^(附\s*+[:：]?\s*+)?条\s*文\s*说\s*明$"
DASHES, PLAIN_DASHES = "－—–‐−", "-----"

REFUSAL = "本知识库未收录该内容"
NO_HIT_REPLY = "本知识库未收录该内容。"
#: Faults of a whole answer in words.
REASONS = {"empty_answer": "答案为空", "model_refused": "模型按铁律拒答", "no_citation": "答案没有标注任何条文号，无法核实出处"}
#: Faults of a citation in words: {0} is the clause, {1} the standards that have it, {2} those that the answer names.
CITATION_REASONS = {
    "not_in_hits": ("条文号 ", 0, " 不在本次检索片段里"),
    "standard_mismatch": ("第 ", 0, " 条出自 ", 1, "，答案却标成 ", 2),
    "ambiguous_article": ("第 ", 0, " 条在 ", 1, " 里都有，答案没有指明出处"),
}
#: A secret that is not set, and what stands between and behind the ends of a long one.
UNSET, MASKED = "(未设置)", ("…", "（长度 ", "）")
EXTRACT_HEAD = "【降级·抽取式回答】模型生成的回答未通过引用校验，以下直接引用检索片段原文："

QUESTION_CHARS = "的了吗呢吧啊什么怎样怎么如何为啥哪些哪个多少能否可否可以应该需要要求规定是否包括请给出说明一下为什么这那有以为对把被几多个条条款项"
QUESTION_WORDS = (
    "什么", "怎么", "怎样", "如何", "哪些", "哪个", "多少", "可以", "需要", "应该",
    "要求", "规定", "定义", "包括", "是否", "能否", "可否", "给出", "说明", "一下",
    "为什么", "是什么", "有哪些", "哪个", "条款", "内容", "问题", "两者", "区别",
    "之间", "其中", "以及", "或者", "还是", "是否应", "能否设",
)

#: Fixed lines of a report; names stand for values.
REPORT = {
    "question": ("❓ ", "question"),
    "answer": ("💬 ", "answer"),
    "degraded": ("⚠️ 已降级（策略 ", "strategy", "）：", "reasons"),
    "kept": ("✅ 引用校验通过（覆盖率 ", "coverage", "）"),
    "domain": ("🎯 域外判定：", "inside", "（top ", "top", "）"),
    "hit": ("  [", "rank", "] ", "score", "  《", "name", "》", "standard", "  第 ", "number", " 条  ［", "status", "］"),
    "tokens": ("（用量：", "tokens", "）"),
}
JOINED, SEE_ABOVE, DOMAIN = "；", "见上", ("域内", "域外")
SOURCES_HEAD = "📎 检索来源（用于核对条文号，也是「引用」块的内容）："
NO_SOURCES = "（检索 0 条 → 未调用大模型，直接拒答）"

FULL, PARTIAL, REPEALED, NONE, UNKNOWN = "全文强制", "部分强条", "原强条已废止", "非强条", "UNKNOWN"
FULL_STANDARDS = ("GB 55031-2022", "GB 55037-2022", "GB 55019-2021")
#: (standard, status of the listed clauses, the clauses); other clauses of these standards have NONE.
LISTED = (
    ("JGJ 38-2015", PARTIAL, ("6.1.2", "6.1.3", "6.2.1", "6.2.2")),
    ("GB 50352-2019", REPEALED, ("4.3.1", "6.7.4", "6.8.6", "6.8.9")),
)

PRESETS = {
    "force-only": {"force_status": {"$in": [FULL, PARTIAL]}},
    "exclude-repealed": {"force_status": {"$ne": REPEALED}},
    "article-only": {"kind": "article"},
    "current": {"status": {"$in": ["现行", "现行(技术参考)"]}},
}
