"""Typed-in rows of the text operators with what is known of them."""

_HEADINGS = [(1, "## 教育背景"), (2, "**专业技能**"), (3, "【项目经历】"), (4, "一、工作经历："), (5, "第二部分：自我评价"), (6, "  plain "), (7, "__证书__"), (8, "（基本信息）"), (9, "")]
_BULLETS = [(1, "- one"), (2, "  1. two"), (3, "2、三"), (4, "（3）four"), (5, "① five"), (6, "（一）six"), (7, "plain"), (8, "* "), (9, "12) x"), (10, "2024 year")]
RESUME = "张三\n电话 123\n教育背景：某某大学 软件工程 本科\n专业技能\n- 精通 Python，了解 Docker\n- 熟悉 FAISS\n工作经历（2 段）\n2020.03 - 2022.06 某公司 工程师\n- 把延迟从 800ms 降到 120ms\n自我评价\n会用 Rust"
JD = "后端工程师\n岗位职责\n负责平台开发\n任职要求：\n1. 必须熟悉 Python，3-5 年经验\n2. 本科及以上学历\n加分项\n了解 Docker 者优先"
DOCS = [(1, RESUME), (2, JD), (3, "no headings at all"), (4, "")]
SKILLS = [("Python", "language", ["python", "py3"], []), ("FAISS", "retrieval", ["faiss"], ["向量检索"]), ("向量检索", "retrieval", ["向量检索"], []), ("Docker", "tool", ["docker"], []), ("Rust", "language", ["rust"], []), ("检索增强生成", "ai", ["检索增强生成", "rag"], [])]
_SKILL_ALIASES = [(a, c) for c, _, al, _ in SKILLS for a in dict.fromkeys([*al, c.lower()])]
_TERMS = [(1, " PY3 "), (1, "python"), (1, "Unknown X"), (2, "rag"), (2, ""), (2, "Docker"), (2, "unknown x")]
_CLAUSES = [(1, "必须熟悉 Python，熟练者优先", "bonus"), (2, "熟悉 Kubernetes 者优先", "requirement"), (3, "熟悉 Java", "bonus"), (4, "了解 Go", "duty"), (5, "Rust", "benefit"), (6, "Rust", "requirement"), (7, "", "summary"), (8, None, "duty")]
_CLAUSE_AT = [(1, "甲，熟悉 Python；乙", 5, 11), (2, "Python", 0, 6), (3, "a：b、Go 、c。d", 4, 6)]
_LEVELS = [(1, "熟悉 Java，精通 Python", "精通", 5), (2, "Python（熟练）", "熟练", 4), (3, "plain Python", None, None), (4, "有所了解 Python", "了解", 2), (5, "精通业务很多很多很多很多很多很多很多 Python", None, None)]
_RANGES = [(1, "2024.03 - 2024.09"), (2, "2023年9月至2024年6月"), (3, "2022/07-至今"), (4, "2019-2023"), (5, "2024-2019"), (6, "none"), (7, "2020.1 ~ now"), (8, "2021 到 2022.05 x")]
_RANGE_SQL = r"(?i)((?:19|20)\d{2})\s*(?:[.\-/年]\s*(0?[1-9]|1[0-2]))?\s*(?:月)?\s*(?:[-~至到]|—|–)+\s*(?:((?:19|20)\d{2})\s*(?:[.\-/年]\s*(0?[1-9]|1[0-2]))?|(至今|现在|今|now|present))"
_NEED = [(1, "3 年以上后端经验", 3, None), (2, "3-5 年", 3, 5), (3, "5-3 年", 3, 5), (4, "应届生", 0, None), (5, "开发经验不少于 2 年", 2, None), (6, "none", None, None), (7, "10年工作经验", 10, None)]
_EDU = [(1, "本科及以上学历", 2, 2), (2, "硕士优先，本科亦可", 2, 3), (3, "博士", 4, 4), (4, "none", None, None), (5, "大专、本科、博士", 1, 4), (6, "Master", None, None)]
_SENIOR = [(1, "Java 实习生"), (2, "2026 届校招"), (3, "Senior Engineer"), (4, "技术专家"), (5, "junior dev"), (6, "工程师"), (7, "x" * 400 + "实习")]
_NUMS = [(i, v) for i, v in enumerate([0.25, 0.35, 2.675, 0.125, 66.25, 1e6 + 0.05, -0.35, 0.0])]
_PAYLOADS = [
    (1, '{"title": " Dev ", "skills": ["Python", "python", "Go"], "bonus": "Go，Rust", "min_years": "3 years"}'),
    (2, 'text ```json\n{"title": "X", "min_years": true, "skills": "A、B"}\n``` end'),
    (3, "no json"),
    (4, 'so: {"title": "a {b} \\"c\\"", "bonus": null} tail }'),
    (5, '[{"title": "first"}, {"title": "second"}]'),
    (6, None),
]
_CLEAN = [(1, "Dev", "Python,Go", "Rust", 3.0), (2, "X", "A,B", "", None), (3, None, None, None, None), (4, 'a {b} "c"', "", "", None), (5, "first", "", "", None), (6, None, None, None, None)]
