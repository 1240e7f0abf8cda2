"""Fixed values of posting analytics: word lists, patterns and limits, as plain text.

They have to equal the values that existing postings were classified with. Lists are in
order where order decides. Patterns are in Java syntax; (?U) makes \\s cover all white space.
"""

# fixed values: projects, buckets and hiring words
BUCKETS = ("校招", "应届生实习", "日常实习")
CAMPUS_WORDS = ("校招", "校园招聘", "秋招", "春招", "正式批", "提前批", "管培生", "应届", "毕业生")
INTERN_WORDS = ("实习", "日常实习", "暑假实习", "寒假实习", "暑期", "寒假", "同学享")
INTERN_PHRASES = ("日常实习", "实习生", "实习岗", "暑假实习", "寒假实习", "暑期实习")
PROJECT_WORDS = ("日常实习", "暑假实习", "寒假实习", "暑期实习", "社会招聘", "秋招", "春招", "校园招聘", "正式批", "提前批")
CAMPUS_PROJECT_WORDS = ("校园招聘", "校招", "秋招", "春招")
OPEN_WORDS = ("在招", "热招", "火热招聘", "正在招聘", "投递中", "开放投递", "立即申请", "立即投递", "欢迎投递", "岗位开放", "招聘中", "网申开启", "启动校园招聘", "正式启动")
INTERNSHIP_WORDS = ("实习", "实习生", "实习岗", "日常实习", "暑假实习", "暑期实习", "寒假实习", "春季实习", "秋季实习", "可转正实习", "实习生招聘")
SECTION_WORDS = ("岗位职责", "任职要求", "职位描述", "工作内容", "岗位要求")
AGGREGATOR_WORDS = ("汇总", "合集", "信息差", "海投", "每日岗", "整理了", "N家", "家公司", "offer研习社", "校招汇总")
ROLE_WORDS = (
    "工程师", "开发", "算法", "产品", "运营", "设计", "分析师", "研究员", "专员", "经理", "管培", "实习生", "实习岗", "顾问", "会计", "法务", "销售",
    "测试", "前端", "后端", "客户端", "数据", "硬件", "嵌入式", "安全", "运维", "HR", "财务", "市场", "增长", "策略", "咨询", "专家",
    "Leader", "Manager", "Specialist", "Engineer", "Intern",
)
TAG_WORDS = {
    "算法": ("算法", "机器学习", "深度学习", "AI"),
    "前端": ("前端", "Frontend", "Web前端"),
    "后端": ("后端", "服务端", "Java", "Go开发", "Python开发"),
    "客户端": ("客户端", "Android", "iOS", "鸿蒙"),
    "测试": ("测试", "QA", "质量保障"),
    "产品": ("产品经理", "产品实习", "产品岗"),
    "运营": ("运营", "用户增长"),
    "数据": ("数据开发", "数据分析", "数据科学", "数仓"),
    "硬件": ("硬件", "嵌入式", "芯片", "IC"),
    "管培": ("管培生", "管培"),
}
NATURES = ("私企", "国企", "央企", "外企", "合资", "事业单位", "政府机关", "民营企业", "民企", "外资", "港澳台资", "其他")
NATURE_SYNONYMS = {"民营企业": "民企", "外资": "外企"}
SKIPPED_SHEET_WORDS = ("表格说明", "内推码", "进度", "模板", "offer")
NO_STATUS = "未投递"

# fixed values: patterns of hiring kinds
INTERN_GRADUATE = r"(?i)(应届(?:生)?实习|校招实习|校园实习|毕业实习|(?:20\d{2}|[2-3]\d)\s*届[^\n]{0,20}实习|实习[^\n]{0,20}(?:20\d{2}|[2-3]\d)\s*届)"
SOCIAL = r"(社会招聘|社招|社会人才|社会招聘正式|正式社招|非校园招聘)"
LABELLED_SOCIAL = r"(?U)(?:招聘类别|招聘类型|招聘项目|类型)\s*[:：]?\s*(社会招聘|社招)\b"
LABELLED_CAMPUS = r"(?U)(?:招聘类别|招聘类型|招聘项目|类型)\s*[:：]?\s*(校园招聘|校招|秋招|春招)\b"
KEEP_CAMPUS = r"(校园招聘|校招|校园|实习生招聘|实习招聘|日常实习|暑期实习|暑假实习|寒假实习|秋招|春招)"
BATCH = r"(?U)(?:20\d{2}|[2-3]\d)(?=\s*届|\s*应届)"
BARE_YEAR = r"(?:^|[（(【\s·,/|])(20\d{2})(?!\s*[-/.年]\s*\d)(?=\s*[）)\]]|[^\d]|$)"
AGGREGATOR_COUNT = r"(?U)整理了\s*\d+\s*家"

# fixed values: titles that are no posting
NOISE_TITLES = (
    "提示", "个人中心", "登录", "注册", "首页", "微官网", "微官网招聘系统", "招聘系统", "招聘系统首页", "校园招聘系统",
    "Moka，智能化招聘管理系统", "moka，智能化招聘管理系统", "智能化招聘管理系统", "欢迎登录", "请登录", "修改密码", "忘记密码", "退出", "退出登录",
    "返回", "更多", "用户协议", "隐私政策", "验证码", "我的简历", "投递记录", "消息中心", "帮助中心", "招聘详细", "招聘系统--招聘详细",
    "招聘系统-招聘详细", "招聘首页", "招聘门户", "招贤纳才", "search jobs", "jobs at apple", "careers", "career", "找到你的理想职位", "找到你的理想职位。",
    "not found", "404", "404 not found", "page not found", "security verification", "安全验证", "人机验证", "校招行程", "招聘行程", "宣讲行程",
    "宣讲会行程", "应聘指南", "了解我们", "关于我们", "职位搜索", "搜索职位", "登录/注册", "登录注册", "招聘人数", "职位名称", "岗位名称", "职位类别",
    "岗位类别", "职位类型", "岗位类型", "工作类型", "工作地点", "工作城市", "更新日期", "更新时间", "发布时间", "发布日期", "当前网页已关停", "网页已关停",
    "网页已关闭", "页面已关停", "页面已关闭", "职位已关闭", "岗位已关闭", "招聘已关闭", "已下线", "停止招聘", "招聘已停止", "招聘已结束", "内部推荐",
    "仅限内推", "内推专用", "仅内部推荐", "内部推荐专用",
)
NOISE_PLACEHOLDER = r"[xX×*]{2,8}|[-—_]{2,8}|[.。…‧]{2,8}|[?]{2,8}|[暂无未知]+"
NOISE_PLACEHOLDER_WORDS = ("n/a", "na", "null", "none", "undefined", "test", "demo")
TEMPLATE_TOKEN = r"(?i)(\{\{|\}\}|item\.(postName|workPlace|positionName|jobName|name)\b|\$\{[^}]+\}|<%[=-]?.+?%>)"
CHANNEL_TITLE = r"(?iU)^.+?\s*[-—–|｜]\s*(?:实习生专项|实习招聘|实习生招聘|日常实习|暑期实习|校园招聘|社会招聘|校招|社招|实习)\s*$"
_CHROME = r"^search\s*jobs\b|\bjobs\s+at\s+apple\b|招贤纳才|招聘首页|招聘门户|招聘官网|招聘网站|职位列表|找到你的理想职位|^careers?\s*[-—–|]|[-—–|]\s*careers?\s*$"
#: For searches: what CHROME_TITLE has besides only matches where one of these does, and takes most of the time on long lines.
#: The look ahead holds what the alternatives begin with.
CHROME_FOUND = rf"(?iU)(?=[sjc招职找\-—–|])({_CHROME})"
CHROME_TITLE = f"(?iU)({_CHROME}" + r"|.{2,40}招聘官网$|.{2,40}招聘门户$|.{2,30}(集团|股份)?有限公司?招聘官网$)"
CHROME_SUFFIX = r"(?iU)\s*[-—–|]\s*(?:招贤纳才|Jobs\s+at\s+Apple|Careers?|招聘首页|招聘门户)(?:\s*[(（][^)）]{0,20}[)）])?\s*$"
BROWSER_TIP = r"(?iU)(兼容模式|旧版\s*IE|IE\s*浏览器|温馨提示|You need to enable JavaScript|(?:Chrome|Firefox|Edge|Safari).{0,20}(?:Chrome|Firefox|Edge|Safari))"
NOISE_TITLE = (
    r"(?iU)^(提示|个人中心|登录|注册|首页|微官网|招聘系统(首页)?|校园招聘系统|欢迎登录|请登录|修改密码|忘记密码|退出(登录)?|用户协议|隐私政策|我的简历|投递记录|消息中心|帮助中心"
    r"|招聘详细|招聘首页|招聘门户|招贤纳才|search\s*jobs|jobs\s+at\s+apple|careers?|找到你的理想职位。?|not\s*found|404(\s*not\s*found)?|page\s*not\s*found"
    r"|security\s*verification|安全验证|人机验证|校招行程|招聘行程|宣讲行程|宣讲会行程|应聘指南|了解我们|关于我们|职位搜索|搜索职位|登录[/／]?注册"
    r"|.{0,8}微官网.{0,8}|.{0,40}招聘系统[-—–]{1,2}招聘详细|.{0,6}招聘系统(首页)?)$"
)
NOISE_NAV_TITLE = r"(校招行程|招聘行程|宣讲行程|宣讲会行程|应聘指南|了解我们|关于我们|职位搜索|搜索职位)"
CLOSED_TITLE = (
    r"(当前网页已关停|网页已关停|网页已关闭|页面已关停|页面已关闭|职位已关闭|岗位已关闭|招聘已关闭|职位已下线|岗位已下线"
    r"|停止招聘|招聘已停止|招聘已结束|仅限内推|内推专用|仅内部推荐|内部推荐专用|内部推荐|^已下线$)"
)
CLOSED_TEXT = (
    r"(职位已关闭|岗位已关闭|该职位已关闭|该岗位已关闭|招聘已结束|已停止招聘|停止招聘|职位已下线|岗位已下线|当前网页已关停|网页已关停|网页已关闭|页面已关停|页面已关闭"
    r"|仅内部推荐|仅限内推|内推专用|只接受内部推荐|仅接受内部推荐|本职位仅限内部|仅对内部开放|仅限内部推荐)"
)
#: Words that the rules look for in whole texts: all are found in one pass (``text.hits``).
LABELS_OF_KIND = ("招聘类别", "招聘类型", "招聘项目", "类型")
CLOSED_WORDS, SOCIAL_WORDS = tuple(CLOSED_TEXT[1:-1].split("|")), tuple(SOCIAL[1:-1].split("|"))
BODY_WORDS = tuple(dict.fromkeys(CLOSED_WORDS + SOCIAL_WORDS + INTERN_PHRASES + INTERNSHIP_WORDS + OPEN_WORDS + CAMPUS_PROJECT_WORDS + LABELS_OF_KIND + ("应届", "届")))

NOISE_PLACES = (
    "团队", "team", "teams", "首页", "更多", "筛选", "搜索", "结果", "排序", "地点", "工作地点", "location", "locations", "关键词", "精确搜索", "搜索结果",
    "全部", "不限", "招聘人数", "需求人数", "职位类别", "工作类型", "更新日期", "发布时间",
)
NAV_LINE = (
    r"(?iU)^(Overview|Summary|Work at Apple|Explore working(?:\s+at\s+Apple)?|Life at Apple|Teams?|Apple Retail|Students?|Related jobs|Similar jobs|Share this job|Apply(?:\s+now)?"
    r"|Search Jobs|Find your role|See all jobs|Browse jobs|招贤纳才|招聘首页|招聘门户|职位列表|校园招聘|团队|学生|零售|概览|相关职位|相似职位|立即申请)\s*$"
)
COMPANY_ENTITY = r"([一-鿿A-Za-z0-9]{2,24}(?:股份有限公司|有限责任公司|有限公司|集团股份|集团|基金|银行|证券|保险|生物科技|生物|科技|制药|药业|电子|通信|汽车|地产|置业))"
COMPANY_SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团股份", "集团", "控股", "股份")
COMPANY_KEY_DROPS = (" ", "　", "（", "）", "(", ")", "股份有限公司", "有限责任公司", "有限公司", "集团股份", "集团")
CHANNEL_SUFFIX = r"(?iU)(?:(?:\s*[-—–|｜]\s*|\s+)(?:实习生专项|实习招聘|实习生招聘|日常实习|暑期实习|校园招聘|社会招聘|校招|社招|实习)\s*|[（(]\s*(?:实习|实习生|校招|社招|校园招聘|社会招聘|实习生专项)\s*[）)]\s*|(?:实习生专项|实习招聘)\s*)+$"
REAL_TITLE_PARTS = r"(岗|工程师|专员|经理|实习|管培|开发|运营|产品|研究|营销|编辑|设计|销售|顾问)"
SHELL_TITLE_WORDS = ("微官网", "招聘系统", "欢迎登录", "Not Found", "Security Verification", "校园招聘入口")
TITLE_PUNCTUATION = "【】[]（）()·・|-_/\\,，.。:：;；!！?？\"'“”‘’"

#: What ends a title made of a company's name and a recruiting word.
RECRUIT_END = r"(?:的)?(?:20\d{2}届?)?(?:校园招聘|校招|春招|秋招|招聘|招聘公告|招聘启事|官网招聘)(?:入口|门户|系统|首页|公告|启事)?[\s】\]]*$"

# fixed values: texts of the publish check by gate
CHECK_TEXTS = {
    "aggregator": "命中汇总黑名单",
    "closed": "关停或内部推荐页，不发布",
    "noise": "噪声标题（导航/登录等）",
    "mismatch": "标题公司名与种子严重不符",
    "source": "源未验证为官方",
    "missing": "缺少硬字段（单位侧标题/原文/招聘项目）",
    "confidence": "置信度不足",
}

# fixed values: URLs
TRUSTED_HOSTS = ("mokahr.com", "moka.com", "zhiye.com", "jobs.feishu.cn", "jobs.f.mioffice.cn", "italent.cn", "tms.beisen.com", "hotjob.cn", "wecruit.hotjob.cn")
CAMPUS_PATHS = ("/campus", "campus_", "/recruit", "/career", "/school", "/joinus", "job.bank", "/jobs")
DETAIL_MARKS = ("detail", "jobadid", "/position/", "/job/", "campus_apply")
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "from", "spm")
IDENTITY_KEYS = ("__job", "id", "job", "job_id", "jobadid", "jobcode", "jobid", "position", "positionid", "post", "postid", "recruitmentid")
DETAIL_KEYS = ("jobid", "job_id", "jobadid", "positionid", "position_id", "postid", "post_id", "recruitmentid", "noticeid")
LISTING_ENDS = ("/campus", "/campus/jobs", "/intern", "/intern/jobs", "/career", "/careers", "/recruit", "/joinus", "/school")
LISTING_FRAGMENTS = ("/jobs", "/campus", "/intern", "/home")
LISTING_MARKS = ("/web/index/campus", "companylist", "/campus-recruitment/", "/social-recruitment/")
NAV_URL = r"(?i)(login|logout|register|signin|signup|password|forgot|/user(?:/|$)|/account(?:/|$)|/ucenter|/passport|个人中心|登录|注册|/help(?:/|$)|/about(?:/|$)|/privacy|getAboutUs|aboutUs|schedule|行程|twoColumnId=100301)"
DETAIL_URL = (
    r"(?i)(job[_-]?detail|/details?/\d+|/jobs?/|jobadid|positionid|/position/[^/]+/detail|/position(?:/|$)|/post(?:/|$)|campus_apply|/recruitment/detail|announcement|/notice(?:/|$)"
    r"|/career/.+/detail|/school/.+/detail)"
)
DETAIL_URL_STRICT = r"(?i)(job[_-]?detail|posdetail|campusxq|jobadid|positionid|/position/[^/]+/detail|/recruitment/detail|/career/.+/detail)"
DETAIL_PATH = r"(?i)/(?:job|jobs|position|positions|post|posts)/[^/?#]+(?:/detail)?/?$"
DETAIL_TEXT = r"(详情|岗位|职位|投递|申请|实习|校招|管培|工程师|分析师|研究员|专员|经理|开发|运营|产品|设计|财务|法务|销售)"
JOB_FRAGMENT = r"(?i)(?:^|/)job/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?:$|[/?#])"
#: Host patterns by adapter, first match wins.
ADAPTER_HOSTS = (("moka", ("mokahr.com", "moka.com")), ("zhiye", ("zhiye.com",)), ("feishu", ("jobs.feishu.cn", "jobs.f.mioffice.cn")), ("hotjob", ("hotjob.cn",)), ("wechat", ("mp.weixin.qq.com",)))

# fixed values: limits
LOOKBACK_DAYS, LIST_MONTHS, RETENTION_DAYS, REVIEW_MONTHS, SOON_DAYS = 90, 6, 365, 3, 7
PASS_MARK, LEAST_TEXT, TEXT_WINDOW, CLIP = 0.55, 40, 800, 96
SYNC_PAGE, PUSH_CHUNK, COMPANY_BATCH, LIST_CAP = 1000, 200, 50, 200
LOGIN_FAILURES, LOGIN_WINDOW_MINUTES, SESSION_HOURS = 5, 15, 12
