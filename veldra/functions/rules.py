"""Fixed values of the rule tables.  The IDs are those of the operator inventory."""

from __future__ import annotations

#: Evidence code -> (direction, weight, identity anchor, hard reject).
EVIDENCE = {
    "official_domain_match": ("POSITIVE", 35, True, False),
    "verified_ats_tenant": ("POSITIVE", 20, True, False),
    "official_site_confirms_ats_tenant": ("POSITIVE", 45, True, False),
    "recruitment_structure": ("POSITIVE", 15, False, False),
    "apply_action": ("POSITIVE", 15, False, False),
    "official_site_backlink": ("POSITIVE", 15, True, False),
    "legal_entity_match": ("POSITIVE", 35, True, False),
    "official_announcement_lists_url": ("POSITIVE", 35, True, False),
    "ats_fingerprint_only": ("NEUTRAL", 0, False, False),
    "candidate_self_domain": ("NEUTRAL", 0, False, False),
    "llm_advisory": ("NEUTRAL", 0, False, False),
    "blocked_page": ("NEUTRAL", 0, False, False),
    "aggregator_domain": ("NEGATIVE", -70, False, True),
    "university_employment_site": ("NEGATIVE", -60, False, True),
    "news_reprint": ("NEGATIVE", -50, False, True),
    "training_provider": ("NEGATIVE", -60, False, True),
    "company_identity_conflict": ("NEGATIVE", -80, False, True),
    "private_or_payment_risk": ("NEGATIVE", -100, False, True),
}

#: Closed vocabularies.
PAGE_TYPES = ["CAREER_HOME", "CAMPAIGN", "JOB_LIST", "JOB_DETAIL", "APPLY", "PLATFORM_ONLY", "UNKNOWN"]
VERIFICATION_STATUSES = ["VERIFIED", "REVIEW", "REJECTED", "BLOCKED", "UNVERIFIED"]
RECRUITMENT_TYPES = ["CAMPUS_FULL_TIME", "CAMPUS_INTERNSHIP", "DAILY_INTERNSHIP", "EXPERIENCED", "SPECIAL_PROGRAM"]
EVENT_STATUSES = ["OPEN", "CLOSED", "UNKNOWN"]
OPENING_STATUSES = ["ACTIVE", "CLOSED", "UNKNOWN"]
SOURCE_TIERS = ["OFFICIAL_SITE", "OFFICIAL_ATS", "PLATFORM_ONLY"]
PUBLICATION_CLASSES = ["EXPLICIT", "INFERRED", "UNKNOWN", "PLATFORM_ONLY"]

#: Hosts by what they are.
SEARCH_ENGINES = ["baidu.com", "google.com", "bing.com", "sogou.com", "so.com"]
HARD_EXCLUDED = ["jobui.com", "51job.com", "nowcoder.com"]
UNIVERSITY_SITES = ["ncss.cn", "91wllm.cn", "91wllm.com"]
PLATFORMS = [("liepin.com", "LIEPIN", r"(?i)^/company-jobs/\d+/?$"), ("zhipin.com", "BOSS", r"(?i)^/(?:gongsir|gongsi)/[a-z0-9_-]+(?:\.html)?/?$")]

#: What pages of gone postings, listings, challenges and open postings say.
EXPIRED_TEXT = [
    r"(?:this\s+)?(?:role|position|job)\s+does not exist or is no longer available",
    r"job (?:is )?no longer available",
    r"job.*no longer open",
    r"position has been filled",
    r"this job has expired",
    r"job posting has expired",
    r"no longer accepting applications",
    r"this (?:position|role|job) (?:is )?no longer",
    r"this job (?:listing )?is closed",
    r"job (?:listing )?not found",
    r"the page you are looking for doesn.t exist",
    r"applications?\s+(?:(?:have|are|is)\s+)?closed",
    r"closed on \d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"closed on (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{1,2}",
    r"diese stelle (?:ist )?(?:nicht mehr|bereits) besetzt",
    r"offre (?:expirée|n'est plus disponible)",
]
LISTING_TEXT = [r"\d+\s+jobs?\s+found", r"search for jobs page is loaded"]
CHALLENGE_TEXT = [
    r"just a moment",
    r"performing security verification",
    r"checking your browser before",
    r"verify you are (?:a |not a )?human",
    r"enable javascript and cookies to continue",
    r"attention required.*cloudflare",
    r"ray id",
    r"cf-ray",
    r"please complete the security check",
]
APPLY_TEXT = [r"apply", r"solicitar", r"bewerben", r"postuler", r"submit application", r"easy apply", r"start application", r"ich bewerbe mich", r"aplikuj", r"panelu aplikowania", r"wyślij (?:cv|aplikacj)"]

#: Tiers in order and the words of a title that show them.
TIERS = [
    ("senior", r"chief|vp|vice\s+president|director|principal|staff|lead|senior|sr|head\s+of|[a-z]{2,}[\s-](?:iii|iv|v)"),
    ("mid", r"mid-level|mid|[a-z]{2,}[\s-]ii|l4|l5"),
    ("entry", r"entry-level|entry|associate|junior|[a-z]{2,}[\s-]i|l1|l2"),
    ("intern", r"internship|intern|trainee|co-op"),
]

#: C10
JOB_BUCKETS = {"internship": "实习", "full_time": "全职", "experienced": "社招"}
BUCKET_NAMES = {
    "internship": ["internship", "intern", "co-op", "coop", "internships", "实习", "实习生"],
    "full_time": ["full_time", "full-time", "fulltime", "fulltime_job", "全职"],
    "experienced": ["experienced", "experienced-hire", "experienced_hire", "social", "社会招聘", "社招"],
}

#: C11: industry -> (label, words that show it, words that speak against it), in order.
INDUSTRIES: dict[str, tuple[str, list[str], list[str]]] = {
    "internet_ai_software": ("互联网/AI/软件", ["software", "developer", "product manager", "growth", "data scientist", "machine learning", "llm", "artificial intelligence", "ml ops", "platform", "backend", "frontend", "full stack", "互联网", "人工智能", "AI", "软件", "网络安全", "游戏", "大模型", "前端", "后端", "运维", "产品经理", "算法"], ["semiconductor"]),
    "electronics_semiconductor": ("电子/半导体", ["semiconductor", "asic", "soc", "fpga", "rtl", "verification", "analog", "mixed signal", "serdes", "cv", "electrical engineer", "半导体", "芯片", "IC", "集成电路", "模拟", "数字", "验证", "序列", "平面设计", "硬件", "量产", "锁相器", "EDA", "摄像头", "光学光电"], []),
    "mechanical_manufacturing": ("机械装备/智能制造", ["mechanical", "manufacturing", "industrial automation", "plc", "cnc", "embedded", "iot", "robotics", "control system", "production planning", "机械", "制造", "工业自动化", "智能制造", "机电", "PLC", "嵌入式", "物联网", "机器人"], []),
    "finance_banking": ("金融/银行/保险", ["bank", "investment", "finance", "financial", "accounting", "accountant", "asset management", "risk", "audit", "compliance", "quant", "wealth", "securities", "private equity", "fintech", "金融", "银行", "证券", "保险", "基金", "金融工程", "实习生财务", "保险理赔", "金融运营"], []),
    "education_training": ("教育/培训", ["education", "teacher", "tutor", "training", "university", "k12", "school", "curriculum", "教育", "教师", "培训", "学校", "教务", "课程", "业务", "课外咨询"], []),
    "biopharma_healthcare": ("生物医药/医疗", ["pharma", "biotech", "medical", "clinical", "healthcare", "hospital", "pharmacist", "biology", "research associate", "drug development", "regulatory", "生物", "医药", "临床", "医院", "药学", "药理", "医生", "医疗"], []),
    "state_owned_enterprise": ("央国企/事业单位", ["central", "state-owned", "soe", "public institution", "government", "civil servant", "research institute", "事业单位", "处长", "sasac", "院士", "军工", "中央企业", "央企", "国企", "事业单位", "军工", "中央企业", "中国工程院"], []),
    "consumer_retail_ecommerce": ("消费品/零售/电商", ["consumer", "retail", "ecommerce", "merchandise", "category manager", "cpg", "fmcg", "shopping", "mall", "消费品", "零售", "电商", "商超", "购手", "SKU", "供应链", "货物动位"], []),
    "auto_driving": ("汽车/智能驾驶", ["autonomous driving", "self-driving", "adas", "adas algorithm", "automotive", "vehicle", "battery management", "智驾", "自动驾驶", "车联网", "汽车", "智能车载", "电池", "火车头", "动力总成"], []),
    "energy_environment": ("能源/环保", ["renewable", "solar", "wind", "battery", "oil and gas", "petrochemical", "energy storage", "hydrogen", "能源", "光伏", "风电", "电池", "石化", "储能", "环保", "碳中和", "电力", "太阳能", "核能"], []),
    "chemicals_materials": ("化工/材料", ["chemical", "materials", "polymer", "ceramic", "carbon", "nanomaterial", "化工", "材料", "高分子", "陶瓷", "碳材料", "钴材", "有机化学"], []),
    "hardware_iot": ("智能硬件/机器人/物联网", ["hardware", "iot", "robotics", "drone", "uav", "wearable", "embedded system", "iot device", "智能硬件", "机器人", "无人机", "可穿戴", "硬件工程", "嵌入式"], []),
    "transport_logistics": ("交运/物流", ["logistics", "supply chain", "shipping", "freight", "aviation", "railway", "port", "trucking", "warehouse", "交运", "物流", "供应链", "船舶", "航空", "铁路", "港口"], []),
    "aerospace_defense": ("高端装备/航天航空/军工", ["aerospace", "satellite", "avionics", "defense", "radar", "sonar", "guidance", "laser", "lidar", "航天航空", "航天", "卫星", "雷达", "军工", "导弹"], []),
    "media_advertising": ("媒体/广告/PR", ["media", "advertising", "pr", "marketing", "brand", "social media", "content", "editor", "writer", "journalist", "reporter", "媒体", "广告", "公关", "品牌", "营销", "社交", "内容", "编辑", "记者", "询问"], []),
    "consulting_legal_audit": ("咨询/法务/审计", ["consulting", "legal", "lawyer", "paralegal", "audit", "tax", "compliance", "advisory", "咨询", "法务", "审计", "税务", "合规", "项目咨询", "管理咨询"], []),
    "interdisciplinary": ("其他/跨领域", [], []),
}

#: Role family -> pattern, in order.
ROLE_FAMILIES = [
    ("嵌入式", r"嵌入式|单片机|固件|firmware|mcu(?![A-Za-z0-9_])"),
    ("硬件", r"硬件|电路|射频|芯片|半导体|fpga|pcb|电子工程"),
    ("人工智能", r"人工智能|机器学习|深度学习|算法工程|大模型|ai(?![A-Za-z0-9_])|aigc|nlp|计算机视觉"),
    ("UI/UX设计", r"ui\s*[/／-]?\s*ux|用户体验|交互设计|视觉设计|界面设计|产品设计师"),
    ("跨境电商", r"跨境电商|海外电商|亚马逊运营|amazon|shopee|lazada|独立站"),
    ("广告", r"广告|媒介投放|广告策划|广告优化|品牌传播|创意策划"),
    ("市场营销", r"市场营销|市场推广|营销策划|品牌营销|增长营销|市场部|marketing"),
    ("金融", r"金融|投行|证券|基金|银行|保险|量化|风控|审计|财务|会计"),
    ("管培生", r"管培生|管理培训生|management\s*trainee"),
    ("新媒体/内容", r"新媒体|内容运营|内容策划|编辑|文案|短视频|直播运营"),
    ("运营", r"运营|用户增长|社区运营|活动运营|商业化运营|策略运营"),
    ("产品", r"产品经理|产品助理|产品运营|产品策划"),
    ("数据", r"数据分析|商业分析|数据科学|数据开发|数据工程|bi(?![A-Za-z0-9_])"),
    ("销售/商务", r"销售|商务拓展|客户经理|渠道|大客户|bd(?![A-Za-z0-9_])"),
    ("供应链/采购", r"供应链|采购|物流|仓储|计划管理|质量管理"),
    ("人力资源", r"人力资源|招聘专员|hrbp|hr(?![A-Za-z0-9_])|组织发展|薪酬绩效"),
    ("咨询", r"咨询顾问|战略咨询|管理咨询|行业研究"),
    ("软件研发", r"软件|开发工程|前端|后端|客户端|测试开发|运维|云计算|java|python|golang|c\+\+|ios|android"),
]

#: C14: batch -> pattern, in order.
BATCHES = [
    ("提前批", r"提前批|提前招聘|early\s*program"),
    ("补录", r"补录|补招|补充招聘"),
    ("暑期实习", r"暑期.*实习|summer\s+intern"),
    ("日常实习", r"日常实习|长期实习|实习生|intern"),
    ("秋招", r"秋招|秋季(?:校园)?招聘"),
    ("春招", r"春招|春季(?:校园)?招聘"),
    ("社招", r"社招|社会招聘|经验招聘"),
    ("校招", r"校招|校园招聘|应届|(?:20)?2\d届"),
]

#: Penalties of a posting's trust score.
TRUST = {"invalid_url": 50, "missing_apply_url": 40, "suspicious_domain": 25, "company_domain_mismatch": 15}
TRUSTED_ATS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "teamtailor.com", "workable.com", "bamboohr.com", "recruitee.com", "icims.com", "jobvite.com"]

#: Hosts and words of a candidate's score.
SEARCH_HOSTS = ["baidu.com", "so.com", "sogou.com", "bing.com", "duckduckgo.com", "google.com"]
VENDOR_HOSTS = ["jobs.lever.co", "job-boards.greenhouse.io", "jobs.ashbyhq.com", "myworkdayjobs.com", "jobs.smartrecruiters.com", "teamtailor.com", "apply.workable.com", "jobs.bamboohr.com", "boards.greenhouse.io", "pinpoint.bamboohr.com", "recruitee.com"]
AGGREGATOR_HOSTS = ["linkedin.com", "indeed.com", "glassdoor.com", "glassdoor.com.au", "glassdoor.com.hk", "glassdoor.co.uk", "glassdoor.sg", "simplyhired.com", "monster.com", "ziprecruiter.com", "jobstreet.com", "jobthai.com", "jobsdb.com"]
CAREER_WORDS = ["careers", "jobs", "join", "hiring", "招聘", "招聘信息", "岗位", "职位", "work-with-us", "talent"]
CN_AGGREGATORS = ["nowcoder.com", "gankinterview.cn", "langlangwangshen.com", "langlangws.com", "niuqizp.com", "zhipin.com", "liepin.com", "zhaopin.com", "yingjiesheng.com", "shixiseng.com", "wondercv.com", "gaoxiaojob.com"]

#: Risks that reject a candidate.
HIGH_RISKS = ["ip_literal_host", "punycode_domain", "lookalike_official_domain", "personal_form_or_cloud_drive", "payment_or_private_contact_risk", "excessive_cross_domain_redirects", "tls_certificate_error", "identity_conflict"]

#: Rank of a source.
SOURCE_RANK = {"official_ats": 4, "company_site": 3, "verified_platform_apply": 2, "discovery": 1, "unknown": 0}
#: Priority of a link's role; score of a page's role.
LINK_PRIORITY = {"application_form": 6, "job_list": 5, "campaign_announcement": 4, "company_career_home": 3, "official_wechat_announcement": 2, "trusted_repost": 1}
PAGE_ROLE_SCORE = {"APPLY": 6, "JOB_DETAIL": 5, "JOB_LIST": 4, "CAMPAIGN": 3, "CAREER_HOME": 2, "CORPORATE_HOME": 1}
#: A4: labels of recruitment types.
EVENT_LABELS = {"CAMPUS_FULL_TIME": "校园招聘", "CAMPUS_INTERNSHIP": "校园实习", "DAILY_INTERNSHIP": "日常实习", "EXPERIENCED": "社会招聘", "SPECIAL_PROGRAM": "专项招聘"}
