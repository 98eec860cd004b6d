"""The pack for startup and venture news in Korean."""

from __future__ import annotations

from siftwell.packs import Pack, Signal, Template

# All words, patterns and weights of this pack.
PACK = Pack(
    name="startup_news",
    categories={
        "VC / AC": ["VC", "벤처캐피탈", "벤처 투자", "벤처투자", "투자 유치", "투자유치", "시드 투자", "프리A", "Series A", "시리즈A", "AC", "액셀러레이터", "창업기획자", "투자조합", "펀드 결성", "신규 펀드", "벤처펀드"],
        "TIPS / LIPS": ["TIPS", "팁스", "민간투자주도형", "LIPS", "립스", "창업성장기술개발", "딥테크 팁스", "초격차 스타트업", "팁스 선정", "운영사", "추천기업"],
        "농식품 / 딥테크 / ESG / AI / 반도체 / 항공우주": ["농식품", "푸드테크", "애그테크", "스마트팜", "딥테크", "ESG", "AI", "인공지능", "생성형 AI", "반도체", "팹리스", "시스템반도체", "항공우주", "우주항공", "위성", "로켓", "우주 스타트업"],
        "스타트업 / 벤처기업 / 초기창업": ["스타트업", "벤처기업", "초기창업", "창업기업", "예비창업", "창업지원", "보육기업", "데모데이", "IR 피칭", "창업 생태계", "액셀러레이팅"],
        "세컨더리 / 구주매각": ["세컨더리", "구주", "구주매각", "구주 거래", "세컨더리 펀드", "벤처 세컨더리", "회수시장", "엑시트", "투자 회수", "LP 지분", "GP-led", "continuation fund"],
        "해외 VC": ["글로벌 VC", "해외 VC", "실리콘밸리", "Sequoia", "Andreessen Horowitz", "a16z", "Lightspeed", "General Catalyst", "Accel", "Tiger Global", "SoftBank Vision Fund", "Y Combinator", "글로벌 스타트업 투자", "startup", "startups", "venture capital", "funding", "raises", "raised", "seed round", "Series A", "Series B", "fund", "acquires", "acquisition"],
    },
    default_category="스타트업 / 벤처기업 / 초기창업",
    tech_category="농식품 / 딥테크 / ESG / AI / 반도체 / 항공우주",
    overseas_category="해외 VC",
    investment_category="VC / AC",
    secondary_category="세컨더리 / 구주매각",
    program_category="TIPS / LIPS",
    signals=[
        Signal("direct_funding", r'투자\s*유치|투자유치|후속\s*투자|브릿지\s*투자|전략적\s*투자|\bfunding\b|\braises?\b|\braised\b', 13, 7, 3),
        Signal("funding_round", r'(?:프리[-\s]?A|시리즈\s*[A-Z]|Series\s*[A-Z]|\bseed(?:\s+round)?\b|시드(?:\s*투자)?)', 12, 6, 3),
        Signal("fund_formation", r'펀드\s*(?:결성|조성)|(?:first|final)\s+close|\bclose[sd]?\b|클로즈|출자사업|모태펀드|정책펀드', 12, 6, 3),
        Signal("tips_lips", r'(?:스케일업\s*)?(?:TIPS|팁스)|LIPS|립스', 12, 6, 3),
        Signal("poc_validation", r'\bPoC\b|실증(?:사업|지원|협약)?|기술\s*검증|규제\s*특례|샌드박스', 10, 5, 3),
        Signal("startup_support", r'창업기업|스타트업\s*지원|사업화\s*지원|글로벌\s*진출\s*지원|판로\s*지원|액셀러레이팅|보육기업|입주기업|데모데이|\bIR\b|오픈이노베이션|민관협력', 9, 5, 2),
        Signal("startup_policy", r'(?:정부|중기부|중소벤처기업부|창업진흥원|금융위원회|공공기관).{0,40}(?:창업|벤처|스타트업).{0,30}(?:정책|지원|사업|규제|세제|제도)', 10, 5, 2),
        Signal("vc_activity", r'(?:벤처캐피탈|액셀러레이터|운용사|기관투자자|\bVC\b|\bAC\b).{0,30}(?:투자|출자|펀드|동향|자금)', 9, 5, 2),
        Signal("selection_recruitment", r'(?:기업|운영사|스타트업|창업기업).{0,30}(?:선정|모집)|(?:선정|모집).{0,30}(?:기업|운영사|스타트업|창업기업)', 8, 4, 2),
        Signal("exit_financing_environment", r'회수시장|자금\s*조달|IPO|M&A|인수합병|세컨더리|구주\s*매각|벤처투자\s*시장|창업\s*생태계', 9, 5, 2),
        Signal("startup_technology_business", r'(?:AI|딥테크|반도체|로봇|바이오|우주항공|기후테크).{0,35}(?:스타트업|벤처기업|창업기업|사업화|실증)|(?:스타트업|벤처기업|창업기업).{0,35}(?:AI|딥테크|반도체|로봇|바이오|우주항공|기후테크)', 8, 4, 2),
        Signal("vc_actor", r'벤처캐피탈|액셀러레이터|\bVC\b|\bAC\b', 5, 3, 1),
        Signal("startup_actor", r'스타트업|창업기업|벤처기업|초기기업|예비창업|창업자|\bstartups?\b|\bfounders?\b', 0, 0, 0),
        Signal("venture_investment", r'벤처투자|벤처캐피탈|투자\s*유치|자금\s*조달|출자사업|모태펀드|정책펀드|벤처펀드|기관투자자|\bventure\s+capital\b|\bfunding\b', 0, 0, 0),
        Signal("startup_support", r'창업\s*지원|지원사업|사업화\s*지원|판로\s*지원|글로벌\s*진출|액셀러레이팅|보육기업|입주기업|데모데이|오픈이노베이션|민관협력', 0, 0, 0),
        Signal("technology_validation", r'\bPoC\b|실증|기술\s*검증|규제\s*특례|샌드박스|딥테크|AI|인공지능|반도체|로봇|바이오|우주항공|기후테크', 0, 0, 0),
        Signal("policy_regulation", r'창업\s*정책|벤처\s*정책|규제|세제|제도\s*(?:개선|개편|변화)|정책\s*(?:변화|개편|지원)', 0, 0, 0),
        Signal("exit_market", r'회수시장|세컨더리|구주|IPO|M&A|인수합병|엑시트|상장|매각', 0, 0, 0),
        Signal("investment_event", r'투자|펀드|시드|프리[-\s]?A|시리즈\s*[A-Z]|\bseed\b|\bseries\b|\binvestment\b|\binvestors?\b', 0, 0, 0),
        Signal("support_policy_general", r'지원|모집|선정|정책|협력|인프라', 0, 0, 0),
    ],
    concepts={
        "key_sentence": r'투자\s*유치|투자유치|\d[\d,.]*\s*(?:조|억|만)?\s*원|시드|프리[-\s]?A|시리즈\s*[A-Z]|Series\s*[A-Z]|펀드|결성|선정|모집|지원사업|지원|실증|PoC|TIPS|팁스|LIPS|립스|출시|상용화|협약|인수|매각|세컨더리|회수시장|\b(?:funding|raised?|raises?|seed|venture\s+capital|fund|selected?|support(?:ed|s)?|pilot|launched?|acquir(?:ed|es?))\b',
        "claim": r'(?:\d[\d,.]*\s*(?:조|억|만)?\s*원|\d[\d,]*\s*(?:곳|개사|개\s*기업|명|팀)|(?:프리[-\s]?)?시리즈\s*[A-Z]|Series\s*[A-Z])',
        "fact_amount": r'(?:약\s*|최대\s*)?(?:\d[\d,.]*\s*(?:조|억|만)\s*원|\d[\d,.]*\s*(?:달러|원)|\$\s*\d[\d,.]*(?:\s*(?:million|billion))?)',
        "fact_stage": r'(?:프리[-\s]?시리즈\s*[A-Z]|프리[-\s]?[A-Z]|시리즈\s*[A-Z]|Series\s*[A-Z]|시드|브릿지|후속\s*투자|Pre[-\s]?IPO)',
        "fact_count": r'(?:총\s*|신규\s*|최대\s*)?\d[\d,]*\s*(?:곳|개사|개\s*기업|개팀|명|팀)',
        "fact_fund": r'(?:신규\s*)?(?:벤처|세컨더리|블라인드|모태|성장|지역)?\s*펀드',
        "purpose": r'조달|확보한?\s*자금|투자자|참여|목적|사업화|양산|실증|판로|고객|해외|수출|매출|고용|후속|연구개발|R&D|상용|비용|효율|유동성|회수시장|협업|입주공간|컨설팅',
        "measure": r'투입|활용|확대|강화|추진|제공|공급|지원|연계|확보|개선|진출|구축|검증|운영|개발|상용화|인수|선정',
        "specific": r'솔루션|플랫폼|서비스|기술|제품|센터',
        "specific_support": r'솔루션|플랫폼|서비스|기술|제품|정책|지원사업|프로그램|센터|펀드',
        "funding_verb": r'\b([A-Z0-9][A-Za-z0-9&._-]{1,39})\s+(raises?|raised|secures?|secured|closes?|closed|extends?)\b',
        "funding_amount": r'[€$£]\s*\d+(?:[.,]\d+)?\s*(?:million|billion|m|bn)?',
        "funding_seed": r'\b(?:pre[-\s]?)?seed(?:\s+round)?\b',
        "funding_series": r'\bseries\s+[A-H]\b',
        "funding_tail": r'\s*\|\s*EU-Startups\s*$',
        "funding_head": r'^(?:(?:Home|Funding|CLUB|[A-Z][A-Za-z -]+-Startups)\s*(?:[>|/·-]\s*)?){1,5}(?=[A-Z0-9“‘"\'])',
        "market_noise": r'(?:(?:특징주|상한가|하한가|급등주|급락주|목표주가|투자의견))|(?:(?:코스피|코스닥|나스닥).{0,20}(?:상승|하락|마감|출발))|(?:(?:주가|증시|시가총액).{0,20}(?:전망|등락|급등|급락))',
        "ecosystem_link": r'스타트업|창업|벤처|벤처투자|벤처기업|투자\s*유치|액셀러레이터|\bVC\b|\bAC\b|TIPS|팁스|LIPS|립스|모태펀드|벤처펀드|세컨더리|회수시장|오픈이노베이션|\bstartups?\b|\bventure\s+capital\b',
        "target": r'스타트업|창업기업|벤처기업|초기기업|비상장기업|예비창업|신생기업|보육기업|입주기업|\bstartups?\b|\bfounders?\b|\bearly-stage\s+compan(?:y|ies)\b',
        "ecosystem": r'벤처투자|창업\s*생태계|모태펀드|벤처펀드|회수시장|세컨더리|TIPS|팁스|LIPS|립스|\bventure\s+capital\b',
        "actor": r'벤처캐피탈|액셀러레이터|창업기획자|창업지원기관|창업진흥원|중소벤처기업부|중기부|혁신센터|공공기관|정부|금융위원회|금융위|산업은행|기업은행|신용보증기금|기술보증기금|운용사|기관투자자|\bVC\b|\bAC\b',
        "financing": r'투자\s*유치|투자유치|시드|프리[-\s]?A|시리즈\s*[A-Z]|후속\s*투자|브릿지\s*투자|전략적\s*투자|자금\s*조달|출자|펀드\s*(?:결성|조성)|IPO|M&A|인수합병|구주|\bfunding\b|\braises?\b|\braised\b|\binvestment\b',
        "support": r'지원사업|창업\s*지원|사업화\s*지원|글로벌\s*진출\s*지원|판로\s*지원|모집|선정|정책|규제|세제|제도|규제\s*특례|샌드박스|액셀러레이팅|보육|인프라',
        "collaboration": r'오픈이노베이션|\bPoC\b|실증|기술\s*검증|액셀러레이팅|투자\s*연계|민관협력|협업|협력',
        "large_company": r'코스피|코스닥|유가증권시장|상장사|상장기업|유상증자|시설\s*투자|공장\s*(?:증설|신설)|생산시설|제련소|광산\s*투자|삼성|현대|롯데|한화|포스코|에코프로|대기업|그룹사|(?:^|[^A-Za-z])(?:LG|SK)(?=$|[^A-Za-z])',
        "listed": r'코스피|코스닥|유가증권시장|상장사|상장기업|삼성|현대|롯데|한화|포스코|에코프로|대기업|그룹사|(?:^|[^A-Za-z])(?:LG|SK)(?=$|[^A-Za-z])',
        "achievement": r'국민체감|정책\s*성과|특별\s*포상|우수\s*성과|성과\s*\d+건|\d+만\s*돌파|\d+건\s*(?:선정|포상)',
        "capex": r'유상증자|시설\s*투자|공장\s*(?:증설|신설)|제련소|광산|설비\s*투자|생산능력\s*확대|배터리|ESS|니켈',
        "event": r'투자\s*유치|투자유치|시드|프리[-\s]?A|시리즈\s*[A-Z]|후속\s*투자|브릿지\s*투자|펀드\s*(?:결성|조성)|출자사업|모태펀드|벤처투자\s*시장|자금\s*조달|지원사업|창업\s*지원|사업화\s*지원|글로벌\s*진출\s*지원|선정|선발|확정|모집|육성|개소|개막|협력|협업|활성화|오픈이노베이션|\bPoC\b|실증|기술\s*검증|상용화|액셀러레이팅|데모데이|회수시장|세컨더리|구주\s*매각|\bfunding\b|\braises?\b|\braised\b',
        "market_event": r'(?:벤처투자\s*시장|창업\s*생태계|회수시장|벤처기업\s*자금\s*조달).{0,35}(?:강세|회복|확대|증가|감소|위축|개선|개편|활성화|지속|변화)|(?:강세|회복|확대|증가|감소|위축|개선|개편|활성화|지속|변화).{0,35}(?:벤처투자\s*시장|창업\s*생태계|회수시장|벤처기업\s*자금\s*조달)',
        "tech_business": r'(?:(?:AI|인공지능|딥테크|반도체|로봇|바이오|우주항공|항공우주|기후테크|농식품).{0,45}(?:스타트업|창업기업|벤처기업|초격차).{0,45}(?:사업화|실증|상용화|기술검증|R&D|연구개발|육성|지원|선정|선발|확정|투자\s*유치)|(?:스타트업|창업기업|벤처기업|초격차).{0,45}(?:AI|인공지능|딥테크|반도체|로봇|바이오|우주항공|항공우주|기후테크|농식품).{0,45}(?:사업화|실증|상용화|기술검증|R&D|연구개발|육성|지원|선정|선발|확정|투자\s*유치))',
        "origin": r'(?:과거|당시|처음|초기|\d{4}년[^.!?。]{0,30})?\s*(?:직원\s*\d+명(?:의|으로)?\s*)?벤처기업으로\s*출발',
        "investment": r'벤처캐피탈|\bVC\b|\bAC\b|액셀러레이터|창업기획자|투자\s*유치|벤처펀드|모태펀드|출자사업|벤처투자\s*(?:제도|정책|시장)|비상장(?:기업)?.{0,20}자금\s*조달|회수시장|세컨더리|구주|스타트업.{0,20}(?:M&A|IPO)|(?:M&A|IPO).{0,20}스타트업',
        "direct_investment": r'투자\s*유치|투자유치|시드\s*(?:라운드|투자)|프리[-\s]?[A-C]|시리즈\s*[A-C]|Series\s*[A-C]|후속\s*투자|브릿지\s*투자|전략적\s*투자|벤처펀드\s*(?:결성|조성)|모태펀드\s*출자|LP\s*출자|\b(?:seed|funding|raised?|raises?)\b',
        "support_category": r'(?:(?:스타트업|창업기업|벤처기업|초기기업).{0,55}(?:지원|육성|모집|프로그램|전용\s*기능|MOU|협약|실증|PoC|글로벌\s*진출)|(?:지원|육성|모집|프로그램|MOU|협약|실증|PoC|글로벌\s*진출).{0,55}(?:스타트업|창업기업|벤처기업|초기기업)|(?:경과원|진흥원|혁신센터|창업지원기관|공공기관).{0,45}(?:참여기업|창업기업).{0,30}(?:모집|지원|실증))',
        "partnership": r'(?:스타트업|창업기업|벤처기업).{0,50}(?:글로벌\s*진출|사업화|실증|PoC|판로).{0,35}(?:지원|협력).{0,30}(?:MOU|업무협약|협약|체결|맞손)|(?:MOU|업무협약|협약|체결|맞손).{0,55}(?:스타트업|창업기업|벤처기업).{0,40}(?:지원|글로벌\s*진출|사업화|실증|PoC|판로)',
        "institutional_support": r'(?:중기부|중소벤처기업부|과기정통부|정부|공공기관|경과원|진흥원|혁신센터|창업지원기관|AWS|아마존웹서비스|클라우드\s*사업자|플랫폼\s*기업|대기업).{0,70}(?:스타트업|창업기업|벤처기업|참여기업).{0,45}(?:지원|육성|모집|실증|PoC|글로벌\s*진출|전용\s*기능|프로그램)',
        "strong_event": r'(?:투자\s*유치|투자유치|\braises?\b|\braised\b|\bfunding\b)|(?:(?:프리[-\s]?A|시리즈\s*[A-Z]|Series\s*[A-Z]|\bseed(?:\s+round)?\b))|(?:펀드\s*(?:결성|조성)|(?:first|final)\s+close|클로즈)|(?:(?:TIPS|팁스|LIPS|립스).{0,30}(?:선정|지원)|(?:선정|지원).{0,30}(?:TIPS|팁스|LIPS|립스))|(?:(?:스타트업|창업기업|벤처기업).{0,35}(?:선정|모집|지원|실증|PoC|협약|오픈이노베이션))|(?:(?:선정|모집|지원|실증|PoC|협약|오픈이노베이션).{0,35}(?:스타트업|창업기업|벤처기업))|(?:(?:벤처캐피탈|액셀러레이터|\bVC\b|\bAC\b).{0,20}(?:투자|펀드|동향))|(?:(?:정부|중기부|중소벤처기업부|창업진흥원).{0,30}(?:창업|벤처|스타트업).{0,20}(?:정책|지원|사업))',
        "editorial": r'(?:\[(?:칼럼|기고|오피니언|전문가\s*기고)\]|(?:^|\s)(?:칼럼|기고|오피니언)(?:\s|$))|(?:법률\s*(?:리터러시|상식|가이드|조언)|스타트업\s*(?:운영|경영)\s*(?:조언|가이드))|(?:(?:창업자|스타트업).{0,20}(?:알아야\s*할|체크리스트|주의사항|성공하는\s*법))|(?:\b(?:opinion|column|startup\s+advice|founder\s+advice|how\s+to|guide\s+for\s+(?:founders|startups))\b)',
        "outlook": r'(?:(?:산업|시장|업황|기술).{0,20}(?:전망|동향|트렌드|분석))|(?:(?:전망|동향|트렌드|분석).{0,20}(?:산업|시장|업황))|(?:(?:시장\s*규모|산업\s*보고서|기술\s*소개|시장\s*리포트))',
        "large_general": r'(?:(?:삼성|LG|SK|현대|롯데|한화|포스코|대기업|그룹).{0,35}(?:실적|매출|공급|신사업|사업\s*확대|설비\s*투자))|(?:(?:실적|매출|공급|신사업|사업\s*확대|설비\s*투자).{0,35}(?:삼성|LG|SK|현대|롯데|한화|포스코|대기업|그룹))',
        "overseas": r'\b(?:funding|raises?|raised|seed(?:\s+round)?|series(?:\s+[a-z])?|first\s+close|final\s+close|investment\s+round|invests?|invested|venture\s+capital|VC\s+fund)\b',
        "advice": r'\b(?:opinion|column|startup\s+advice|founder\s+advice|how\s+to|tips\s+for|guide\s+for)\b',
        "general_tech": r'(?:AI\s*데이터센터\s*(?:수요|시장|전망))|(?:데이터센터\s*냉각\s*(?:시장|산업|수요|전망))|(?:(?:일반\s*)?AI\s*검색\s*(?:시장|점유율|전망))|(?:에듀테크\s*(?:시장|산업)?\s*전망)|(?:반도체\s*(?:산업|시장|업황)\s*전망)|(?:(?:대기업|그룹|제조사).{0,20}설비\s*투자)',
        "rights_issue": r'유상증자',
        "market_words": r'(?:코스피|코스닥|상장사|상장기업|주가|증시)',
        "plant": r'(?:공장|설비|제련소|광산|생산시설|해외\s*(?:산업\s*)?투자|시설\s*투자)',
        "award": r'(?:국민체감\s*성과|특별\s*포상|포상금|정책\s*성과\s*포상|우수\s*성과\s*포상)',
        "secondary": r'세컨더리|구주|회수시장|LP\s*지분|GP-led|continuation\s+fund',
        "program": r'(?:TIPS|팁스|LIPS|립스)',
        "summary_metadata": r'(?:입력|수정|승인)\s*[:=]?\s*20\d{2}[.\-/년]|조회(?:수)?\s*[:=]?\s*[\d,]+|무단\s*(?:전재|복제|배포)|재배포\s*금지|저작권|copyright|관련\s*기사|구독|댓글|SNS\s*공유|전체\s*맥락을\s*이해하려면\s*기사\s*본문을\s*함께\s*확인하는\s*것이\s*좋습니다|(?:사진|자료)\s*=|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|[A-Za-z0-9가-힣·._-]{2,30}\s*(?:기자|특파원)',
        "fallback_event": r'유치|선정|모집|결성|조성|출시|수상|지원|확대|참여|협약|체결|인수|상용화|추진|실증|개최|매각|확보|조달|투입|제공|연계|개발|고도화|육성|나섬',
        "fallback_strong_event": r'유치|선정|모집|결성|조성|출시|수상|협약|체결|인수|상용화|실증|매각',
        "report_ending": r'(?:유치|선정|모집|결성|조성|출시|수상|지원|확대|참여|협약|체결|인수|상용화|추진|실증|개최|매각|확보|조달|투입|제공|연계|개발|고도화|육성|진행|구축|포함|받음|선보임|나섬|함|됨)$',
        "title_event": r'(?:투자\s*유치|투자유치|시드\s*투자|프리[-\s]?A|시리즈\s*[A-Z]|Series\s*[A-Z]|선정|모집|수상|펀드.{0,20}(?:결성|조성)|(?:결성|조성).{0,20}펀드|출시|상용화|협약|MOU|업무협약|체결|맞손|인수|매각|데모데이\s*개최|\d[\d,.]*\s*(?:조|억|만)\s*원.{0,25}(?:투자|유치|펀드|결성))',
        "english_event": r'\b(?:raise[sd]?|secure[sd]?|fund(?:ing|ed)?|launch(?:es|ed)?|select(?:s|ed)?|support(?:s|ed)?|expand(?:s|ed)?|partner(?:s|ed)?|acquir(?:e[sd]?|ing)|invest(?:s|ed|ment)?|close[sd]?|announce[sd]?|develop(?:s|ed)?|commerciali[sz](?:e[sd]?|ing))\b',
        "sentence_metadata": r'(?:(?:^|\s)(?:입력|수정|승인)\s*[:=]?\s*20\d{2}[.\-/년])|(?:(?:^|\s)조회(?:수)?\s*[:=]?\s*[\d,]+)|(?:무단\s*(?:전재|복제|배포)|재배포\s*금지|저작권|copyright)|(?:관련\s*기사|인기\s*기사|추천\s*기사|구독|댓글|로그인|SNS\s*공유|공유하기)|(?:기사\s*원문\s*보기|원문\s*보기|제보하기|기사\s*제보|구독하기)|(?:전체\s*맥락을\s*이해하려면\s*기사\s*본문을\s*함께\s*확인하는\s*것이\s*좋습니다)|(?:(?:사진|자료|그래픽)\s*=|사진\s*설명)|(?:메뉴|전체기사|최신기사|많이\s*본\s*뉴스|광고\s*문의)|(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})|(?:[A-Za-z0-9가-힣·._-]{2,30}\s*(?:기자|특파원))|(?:^20\d{2}년\s*\d{1,2}월\s*\d{1,2}일(?:\s*\d{1,2}:\d{2})?$)',
        "weak": r'(?:중요하(?:다|다고)|주목(?:된다|받는다)|전망(?:이다|된다)|기대(?:된다|한다))|(?:시장(?:이|은)?\s*(?:성장|확대)할\s*것)|(?:업계\s*관계자는?.{0,30}(?:말했다|설명했다))',
        "advert": r'광고|협찬|무료\s*체험|할인|이벤트|지금\s*신청|뉴스레터|구독',
        "action": r'유치|조달|결성|조성|선정|모집|지원|실증|출시|상용화|협약|인수|매각|수상|개최|확대|참여|투입|확보|개발',
        "context": r'스타트업|벤처기업|창업기업|투자\s*유치|VC|벤처캐피탈|액셀러레이터|TIPS|팁스|LIPS|립스|지원사업|데모데이|\bIR\b|실증|PoC|오픈이노베이션',
        "investment_title": r'투자\s*유치|투자유치|시드\s*(?:라운드|투자)|프리[-\s]?[A-C]|시리즈\s*[A-C]|Series\s*[A-C]|후속\s*투자|브릿지\s*투자|펀드\s*(?:결성|조성)',
        "support_title": r'(?:스타트업|창업기업|벤처기업|초기기업|참여기업).{0,55}(?:지원|육성|모집|프로그램|글로벌\s*진출|실증|PoC|MOU|협약|전용\s*기능)|(?:지원|육성|모집|프로그램|글로벌\s*진출|실증|PoC|MOU|협약).{0,55}(?:스타트업|창업기업|벤처기업|초기기업|참여기업)',
        "body_boilerplate": r'공식\s*누리집|홈페이지에서\s*확인|첨부\s*문서|발표\s*문서|공개\s*자료|신청\s*절차|제출\s*서류|질의응답|담당\s*부서|세부\s*일정|기사\s*제보',
        "investment_fact": r'투자(?:를|를\s*)?\s*(?:유치|받|확보|참여)|투자금|조달한\s*자금|자금\s*조달|시드|프리[-\s]?[A-C]|시리즈\s*[A-C]',
        "investment_size": r'\d[\d,.]*\s*(?:억|조|만)?\s*원|시드|프리[-\s]?[A-C]|시리즈\s*[A-C]',
        "investor": r'투자사|투자자|벤처캐피탈|캐피탈|벤처스|크립톤|참여했|리드했',
        "use_of_funds": r'투자금|조달한\s*자금|자금.{0,20}(?:활용|투입)|사업화|상용화|글로벌\s*진출|해외\s*진출|후속\s*투자|양산',
        "support_fact": r'지원\s*(?:대상|내용|사업|프로그램)|참여기업|참가사|모집|육성|사업화\s*지원|글로벌\s*진출\s*지원|실증\s*지원|PoC|판로|클라우드|컨설팅',
        "support_actor": r'중기부|중소벤처기업부|과기정통부|진흥원|경과원|혁신센터|공공기관|AWS|벤처블릭|주관|운영',
        "support_size": r'지원\s*대상|\d[\d,]*\s*(?:곳|개사|명|팀)|모집\s*규모|사업화|실증|글로벌\s*진출|해외\s*진출|판로',
        "ceremony": r'행사에서는|협약식|기념촬영|네트워킹|축사|참석자',
        "money": r'\d[\d,.]*\s*(?:억|조|만)?\s*원|\d[\d,]*\s*(?:곳|개사|명|팀)',
        "subject": r'[A-Za-z0-9가-힣&·._-]{2,30}(?:은|는|이|가)\s',
        "institution": r'(?:중소벤처기업부|중기부|창업진흥원|금융위원회|산업은행|기업은행|공공기관|협회|재단|센터|벤처스|캐피탈|테크|랩스)',
        "stock_sentence": r'주가|증시|코스피|코스닥|유상증자|상장사|시설\s*투자|공장\s*(?:증설|신설)|제련소|광산\s*투자',
        "promotion": r'국민체감|정책\s*성과|특별\s*포상|우수\s*성과|홍보',
        "complete_ending": r'(?:했다|됐다|한다|된다|이다|있다|없다|나섰다|밝혔다|전했다|추진한다|지원한다|선정했다|유치했다|결성했다|조성했다|출시했다|확대했다|체결했다|참여했다|확보했다|예정이다|계획이다|받았다|열었다|진행한다|제공한다|모집한다|개최한다|상용화했다|개발했다)[.!?。]?$',
        "structured_subject": r'(?:은|는|이|가)\s',
        "structured_action": r'(?:확보|확정|접수|선보임|진행|받음|포함|구축|유치|선정|결성|조성|출시|공개|개발|고도화|상용화|확대|모집|지원|참여|수상|개최|개소|매각|인수|합병|추진)$',
    },
    tech_words=["스타트업", "벤처", "창업기업", "투자", "투자유치", "VC", "AC", "액셀러레이터", "TIPS", "팁스", "지원사업", "데모데이", "IR", "펀드", "선정", "보육기업"],
    sources=["연합뉴스", "뉴스1", "매일경제", "한국경제", "서울경제", "머니투데이", "아시아경제", "파이낸셜뉴스", "이데일리", "조선비즈", "헤럴드경제", "중앙일보", "동아일보", "한겨레", "전자신문", "디지털데일리", "IT조선", "디지털타임스", "ZDNet Korea", "지디넷코리아", "블로터", "플래텀", "벤처스퀘어", "와우테일", "바이라인네트워크", "아웃스탠딩", "AI타임스", "에이아이타임스", "뉴시스", "스타트업투데이", "더벨", "딜사이트", "DealSite경제TV", "비즈워치", "테크M", "테크42", "CIO Korea", "TechCrunch", "VentureBeat", "Crunchbase News", "EU-Startups", "중소벤처기업부", "과학기술정보통신부", "농림축산식품부", "산업통상자원부", "금융위원회", "K-Startup", "창업진흥원", "한국벤처투자", "한국무역협회", "코트라", "KOTRA"],
    advertising=["광고", "이벤트", "할인", "무료체험", "구독 이벤트", "협찬"],
    stopwords=["관련", "기사", "단독", "종합", "공개", "발표", "규모", "신규", "기업", "스타트업", "벤처", "투자", "투자유치", "유치", "시드", "프리", "시리즈a", "시리즈b", "시리즈c", "series", "펀드", "선정", "모집", "결성", "조성", "출시", "수상", "지원", "확대", "참여", "협약", "인수", "상용화", "추진", "억원"],
    vague=["동향입니다", "소식입니다", "관련 기사입니다", "내용을 다룸", "주목됩니다"],
    overseas_sources=["TechCrunch", "Crunchbase", "VentureBeat", "Sifted", "EU-Startups", "PitchBook", "CB Insights"],
    overseas_hosts=["techcrunch.com", "crunchbase.com", "venturebeat.com", "sifted.eu", "eu-startups.com", "pitchbook.com", "cbinsights.com"],
    boilerplate=[
        r'무단\s*(?:전재|복제|배포)',
        r'저작권(?:자)?\s*[©ⓒ]?',
        r'copyright\s*[©(]?',
        r'관련\s*기사',
        r'추천\s*기사',
        r'인기\s*기사',
        r'많이\s*본\s*기사',
        r'기사\s*제보',
        r'기사\s*원문\s*보기|원문\s*보기|제보하기',
        r'댓글\s*(?:쓰기|보기|정책)?',
        r'SNS\s*(?:공유|기사보내기)',
        r'(?:페이스북|트위터|카카오톡|네이버)\s*(?:공유|보내기)',
        r'구독(?:하기|신청)',
        r'뉴스레터\s*(?:구독|신청)',
        r'로그인\s*(?:안내|후)|회원가입',
        r'광고\s*(?:문의|안내)|사이트\s*메뉴',
        r'기자의\s*다른\s*기사',
        r'(?:입력|수정|승인)\s*[:=]?\s*20\d{2}[.\-/년]',
        r'조회(?:수)?\s*[:=]?\s*[\d,]+',
        r'(?:사진|자료)\s*=',
        r'재배포\s*금지',
        r'^(?:Home|Funding|CLUB|[A-Z][A-Za-z -]+-Startups)(?:\s*[>|/·-]\s*)?$',
    ],
    bylines=[
        r'^[가-힣A-Za-z·]{2,20}\s*(?:기자|특파원)\s*=?$',
        r'^20\d{2}년\s*\d{1,2}월\s*\d{1,2}일(?:\s*\d{1,2}:\d{2})?$',
    ],
    paywall=[
        r'구독자만\s*(?:볼|읽을)\s*수',
        r'유료\s*회원(?:만|에게)',
        r'로그인\s*후\s*(?:기사|전체)',
        r'기사\s*전문을\s*보려면',
        r'계속\s*읽으시려면\s*구독',
    ],
    amounts=[
        r'((?:약\s*|총\s*)?\d[\d,.]*\s*(?:조|억|만)\s*원)',
        r'([€$£]\s*\d+(?:[.,]\d+)?\s*(?:million|billion|m|bn)?)',
        r'(\d+(?:[.,]\d+)?\s*(?:million|billion)\s*(?:euros?|dollars?|pounds?))',
    ],
    stages=[
        r'((?:pre[-\s]?)?seed(?:\s+round)?)',
        r'((?:series|시리즈)\s*[A-H])',
        r'(프리[-\s]?[A-H])',
        r'(시드(?:\s*투자|\s*라운드)?)',
        r'(브릿지(?:\s*투자|\s*라운드)?|후속\s*투자|Pre[-\s]?IPO)',
    ],
    companies=[
        r'\b(?:[A-Z][A-Za-z-]+-based|[A-Z]{2,}\s+startup|startup)\s+([A-Z0-9][A-Za-z0-9&._-]{1,39})\s+(?:raises?|raised|secures?|secured|closes?|closed|extends?)\b',
        r'\b([A-Z0-9][A-Za-z0-9&._-]{1,39})\s+(?:raises?|raised|secures?|secured|closes?|closed|extends?)\b',
        r'(?:^|[.!?]\s*)([A-Za-z0-9가-힣][A-Za-z0-9가-힣&·._-]{1,39})(?:은|는|이|가)\s+(?=[^.!?]{0,45}(?:투자\s*유치|유치|선정|모집|결성|출시|인수|협약|실증))',
    ],
    strip=[
        (r'^\s*\[(?:[^\]]{1,40})\]\s*', ""),
        (r'^\s*\([^)]{0,40}=(?:연합뉴스|뉴스1|뉴시스|[^)]*기자)\)\s*', ""),
        (r'^\s*(?:입력|수정|승인)\s*[:=]?\s*20\d{2}[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{1,2}(?:일)?(?:\s*\d{1,2}:\d{2})?\s*', ""),
        (r'\s+[A-Za-z0-9가-힣·._-]{2,30}\s*(?:기자|특파원)\s*$', ""),
        (r'\s*(?:사진|자료)\s*=\s*[^.!?。]{1,80}(?=$|[.!?。])', " "),
        (r'[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', " "),
        ('^(?:(?:Home|Funding|CLUB|[A-Z][A-Za-z -]+-Startups)\\s*(?:[>|/·-]\\s*)?){1,5}(?=[A-Z0-9“‘"\'])', ""),
    ],
    particles="에서는 으로는 에게는 부터는 까지는 에서 에게 으로 은 는 이 가 을 를 와 과 의 에 로".split(),
    endings="하였음 했음 됐음 함 됨".split(),
    bare_endings=["함", "됨"],
    sentence_weights=[
        ("투자 유치", 12),
        ("투자유치", 12),
        ("시드", 8),
        ("프리A", 9),
        ("시리즈A", 10),
        ("시리즈B", 10),
        ("Series A", 10),
        ("Series B", 10),
        ("억 원", 9),
        ("조 원", 9),
        ("펀드", 7),
        ("결성", 9),
        ("VC", 6),
        ("벤처캐피탈", 7),
        ("액셀러레이터", 7),
        ("선정", 9),
        ("모집", 7),
        ("지원", 5),
        ("지원사업", 9),
        ("TIPS", 10),
        ("팁스", 10),
        ("LIPS", 10),
        ("립스", 10),
        ("스타트업", 6),
        ("벤처기업", 7),
        ("창업기업", 7),
        ("실증", 8),
        ("PoC", 8),
        ("오픈이노베이션", 8),
        ("데모데이", 8),
        ("IR", 6),
        ("수상", 8),
        ("출시", 8),
        ("상용화", 8),
        ("협약", 7),
        ("인수", 9),
        ("구주", 10),
        ("세컨더리", 10),
        ("회수시장", 9),
    ],
    category_words={
        "VC / AC": ["투자", "유치", "시드", "시리즈", "펀드", "결성", "VC", "벤처캐피탈", "액셀러레이터", "조달"],
        "TIPS / LIPS": ["TIPS", "팁스", "LIPS", "립스", "선정", "운영사", "지원", "사업화"],
        "농식품 / 딥테크 / ESG / AI / 반도체 / 항공우주": ["스타트업", "벤처", "투자유치", "지원사업", "실증", "PoC", "출시", "사업화", "상용화"],
        "스타트업 / 벤처기업 / 초기창업": ["기업", "서비스", "지원사업", "모집", "선정", "투자유치", "데모데이", "보육"],
        "세컨더리 / 구주매각": ["구주", "LP 지분", "세컨더리", "GP", "회수시장", "거래", "매각"],
        "해외 VC": ["VC", "투자", "라운드", "글로벌", "해외", "확장", "Sequoia", "a16z", "Accel"],
    },
    event_types=[
        ("investment", r'투자\s*유치|투자유치|시드\s*투자|시리즈\s*[a-z]|series\s*[a-z]'),
        ("fund", r'펀드.{0,20}(?:결성|조성)|(?:결성|조성).{0,20}펀드'),
        ("secondary", r'세컨더리|구주|lp\s*지분|회수시장'),
        ("selection", r'선정'),
        ("recruitment", r'모집'),
        ("acquisition", r'인수|합병|m&a'),
        ("launch", r'출시|상용화'),
        ("award", r'수상'),
        ("partnership", r'협약|mou'),
    ],
    event_labels=[
        ("투자유치", r'투자\s*유치|투자유치|\braises?\b|\braised\b|\bsecures?\b.{0,25}\bfunding\b'),
        ("펀드결성", r'펀드\s*(?:결성|조성)|(?:first|final)\s+close'),
        ("TIPS·LIPS 선정", r'(?:TIPS|팁스|LIPS|립스).{0,35}(?:선정|선발)|(?:선정|선발).{0,35}(?:TIPS|팁스|LIPS|립스)'),
        ("선정", r'선정|선발|확정'),
        ("모집", r'모집|참가사\s*접수|지원기업\s*접수'),
        ("실증·PoC", r'\bPoC\b|실증|기술\s*검증'),
        ("출시·상용화", r'출시|상용화|공개'),
        ("인수·M&A", r'인수|합병|M&A|acquir'),
        ("협약", r'협약|MOU|맞손|partnership'),
        ("세컨더리", r'세컨더리|구주|LP\s*지분|회수시장'),
        ("지원사업", r'지원사업|사업화\s*지원|글로벌\s*진출\s*지원|창업기업.{0,25}지원'),
    ],
    industries=[
        ("AI", r'(?:생성형|피지컬|의료|산업용)?\s*AI|인공지능'),
        ("바이오·헬스케어", r'바이오|헬스케어|의료|신약|ADC'),
        ("반도체", r'반도체|팹리스|칩렛'),
        ("로봇", r'로봇|로보틱스'),
        ("기후테크·ESG", r'기후테크|클린테크|CCUS|탄소|ESG'),
        ("우주항공", r'우주항공|항공우주|위성|로켓'),
        ("농식품", r'농식품|푸드테크|애그테크|스마트팜'),
        ("사이버보안", r'사이버\s*보안|cybersecurity'),
        ("핀테크", r'핀테크|fintech'),
        ("SaaS", r'\bSaaS\b|소프트웨어\s*서비스'),
    ],
    # Words, endings and wordings of headlines.
    actions=[
        "투자 유치", "투자유치", "펀드 결성", "펀드 조성", "선정", "모집", "지원", "확대", "출시", "공개", "개발", "고도화", "상용화", "개소", "개최", "수상", "참여",
        "인수", "합병", "매각", "맞손",
    ],
    subject_ends="맞손 선정 모집 지원 출시 개발 결성 조성 개최 개소".split(),
    nobody=["기술 기업", "스타트업", "기업", "업계", "시장", "정부", "VC"],
    report_stems=[
        ("선정", ["됐", "되었", "했다", "한다", "해졌다"]), ("모집", ["했", "한다", "에 나선"]), ("지원", ["했", "한다", "에 나선"]),
        ("확대", ["했", "한다", "됐다", "되었다"]), ("출시", ["했", "한다", "됐다"]), ("공개", ["했", "한다", "됐다"]), ("개발", ["했", "한다", "에 성공했다"]),
        ("고도화", ["했", "한다", "됐다"]), ("상용화", ["했", "한다", "됐다"]), ("결성", ["했", "한다", "됐다"]), ("조성", ["했", "한다", "됐다"]),
        ("개최", ["했", "한다", "됐다"]), ("개소", ["했", "한다", "됐다"]), ("참여", ["했", "한다", "됐다"]), ("수상", ["했", "한다"]),
        ("투입|활용|확대|강화|추진|제공|공급|지원|연계|확보|개선|진출|구축|검증|운영", [r"할\s*(?:계획|예정|방침)(?:이다)?", "한다", "했다", "된다", "됐다"]),
    ],
    report_plans=[(r"(?:할\s*(?:계획|예정|방침)(?:이다)?|할\s*것(?:이다)?|예정이다)$", "추진")],
    joined_endings=[
        (r"투자\s*유치$", "투자 유치해"), (r"후속\s*투자$", "후속 투자에 참여해"), (r"펀드\s*(결성|조성)$", "펀드를 $1해"),
        ("(선정|출시|공개|개발|고도화|상용화|확대|참여|수상|개최|개소|확보)$", "$1해"), ("모집$", "모집하며"), ("지원$", "지원하며"),
    ],
    cut_endings="투자 유치|유치|선정|결성|조성|출시|공개|개발|고도화|상용화|확대|모집|지원|참여|수상|개최|개소|매각|인수|합병|추진|퇴장|형성".split("|"),
    openers=[r"(?:회사|기업|기관|정부|운영사들?|선정\s*기업들?|이\s*펀드|펀드|이들)(?:은|는|이|가|에는)?\s*", r"(?:이를|이번\s*투자를|조달한\s*자금을?)\s*"],
    key_heading="핵심 문장:",
    no_summary="기사 제목에서 확인되는 핵심 사실 없음",
    templates=[
        Template("fund", words=(["펀드"], ["결성", "조성"]), lacking="펀드", instead="{fund} 결성", detail="supporting"),
        Template("program", words=(["TIPS", "팁스", "LIPS", "립스"],), facts=("amount", "count"), detail="supporting", swaps=((r"^맞손\s*[,.:]*", "협력해"),)),
        Template("secondary", words=(["세컨더리", "구주", "회수시장", "LP 지분", "GP-led"],), detail="supporting"),
        Template("support", words=(["모집", "선정", "지원사업", "지원 대상", "지원 확대", "공고"],), facts=("amount", "count"), detail="longer", swaps=((r"^맞손\s*[,.:]*", "협력해"),)),
        Template("award", "{leading?로 }{bare} 수상", pattern="(?:대상|상|원장상)[\"”'’]?$", facts=(), detail="supporting"),
        Template(
            "investment", title_only=True, facts=("amount", "stage"), detail="supporting", lacking=r"투자\s*유치|시드\s*투자|후속\s*투자|투자\s*참여", instead="{clause} 투자 유치",
            words=(["투자 유치", "투자유치", "시드 투자", "시리즈A", "시리즈B", "시리즈C", "Series A", "Series B", "Series C", "후속 투자", "투자 참여"],),
        ),
        Template("technology", words=(["출시", "공개", "기술 개발", "솔루션", "플랫폼", "고도화", "상용화", "개소"],), facts=(), detail="specific"),
        Template("other", facts=("amount", "stage")),
    ],
    title_templates=[
        Template("investment", "{actor} {stage? 단계에서 }{amount?의 }신규 투자 자금을 확보", r"투자\s*유치|투자유치|시드\s*투자|시리즈\s*[A-Z]"),
        Template("fund", "{actor} {amount? 규모의 }{target:을} 새로 조성", r"(?=.*펀드).*(?:결성|조성)", cut=r"\s*(?:결성|조성).*$", swaps=((r"^(?:약\s*)?\d[\d,.]*\s*(?:조|억|만)\s*원(?:\s*규모)?\s*", ""),), default="신규 펀드"),
        Template("selecting", "{actor} {target} 명단을 최종 확정", "선정", subject="(?:부|청|원|센터|은행|공사|재단|진흥원)$", cut=r"\s*선정.*$"),
        Template("selected", "{actor} {target} 대상 명단에 포함", "선정", cut=r"\s*선정.*$"),
        Template("recruiting", "{actor} {target} 신청을 접수", "모집", cut=r"\s*모집.*$", swaps=((r"참여\s*기업", "참가 기업"),)),
        Template("launch", "{actor} {target:을} 시장에 선보임", "출시", cut=r"\s*출시.*$"),
        Template("held", "{actor} {target} 일정을 진행", "개최", cut=r"\s*개최.*$", swaps=(("밋업데이", "밋업 행사"),)),
        Template("certified", "{actor} {target:을} 받음", r"인증\s*획득", cut=r"\s*획득.*$"),
        Template("partners", "{actor} {target} 협력 체계를 구축", "업무협약|MOU|맞손", cut=r"\s*(?:업무협약|MOU|맞손).*$"),
        Template("award", "{actor} {target} 평가의 수상자 명단에 포함", "수상|대상$", cut=r"\s*(?:수상|대상).*$"),
    ],
)
