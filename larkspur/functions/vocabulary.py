"""Fixed values of the rules: word lists, patterns, weights and thresholds, as results depend on them.

Patterns are searched in either letter case; \\b is an ASCII word border (see text.word_borders).
"""

# --- places -------------------------------------------------------------------------------------------

#: (key, shown name, patterns), first match in this order wins.
LOCATIONS = [
    ("haifa", "חיפה", ["חיפה", "haifa"]),
    ("krayot", "קריות", ["קריות", r"קרית\s*אתא", r"קריית\s*אתא", r"קרית\s*ביאליק", r"קריית\s*ביאליק", r"קרית\s*ים", r"קריית\s*ים", r"קרית\s*מוצקין", r"קריית\s*מוצקין", "krayot", "kiryat"]),
    ("yokneam", "יקנעם", ["יקנעם", "yokneam"]),
    ("netanya", "נתניה", ["נתניה", "netanya"]),
    ("hod_hasharon", "הוד השרון", [r"הוד\s*השרון", r"hod\s*hasharon"]),
    ("tel_aviv", "תל אביב", [r"תל\s*אביב", r"tel\s*aviv"]),
    ("herzliya", "הרצליה", ["הרצליה", "herzliya"]),
    ("raanana", "רעננה", ["רעננה", "raanana"]),
    ("petah_tikva", "פתח תקווה", [r"פתח\s*תקווה", r"פתח\s*תקוה", r"petah\s*tikva"]),
    ("ramat_gan", "רמת גן", [r"רמת\s*גן", r"ramat\s*gan"]),
    ("holon", "חולון", ["חולון", "holon"]),
    ("rishon_lezion", "ראשון לציון", [r"ראשון\s*לציון", "rishon"]),
    ("rehovot", "רחובות", ["רחובות", "rehovot"]),
    ("jerusalem", "ירושלים", ["ירושלים", "jerusalem"]),
    ("beer_sheva", "באר שבע", [r"באר\s*שבע", r"beer\s*sheva"]),
    ("ashdod", "אשדוד", ["אשדוד", "ashdod"]),
    ("ashkelon", "אשקלון", ["אשקלון", "ashkelon"]),
    ("karmiel", "כרמיאל", ["כרמיאל", "karmiel"]),
    ("nahariya", "נהריה", ["נהריה", "nahariya"]),
    ("acre", "עכו", ["עכו", "acre", "akko"]),
    ("remote", "Remote", ["remote", "hybrid", "היברידי", "מרחוק", r"עבודה\s*מהבית"]),
    ("north", "צפון", ["צפון", "northern"]),
    ("center", "מרכז", ["מרכז", r"גוש\s*דן", "center"]),
    ("sharon", "השרון", ["השרון", "sharon"]),
]
#: Three vocabularies that differ on purpose: of the scores, of the gates, of the main list.
SCORE_GOOD_PLACES = ["haifa", "krayot", "yokneam", "karmiel", "nahariya", "acre", "north", "remote", "nesher", "tirat_carmel"]
SCORE_BAD_PLACES = ["tel_aviv", "jerusalem", "center", "beer_sheva", "ashdod", "ashkelon", "holon", "rishon_lezion", "netanya", "petah_tikva", "raanana", "ramat_gan", "hod_hasharon", "herzliya", "rehovot", "sharon"]
GATE_GOOD_PLACES = ["haifa", "krayot", "kiryat_ata", "yokneam", "karmiel", "nahariya", "acre", "akko", "north", "remote", "nesher", "tirat_carmel", "hadera", "יזרעאל", "בית_שאן"]
GATE_BAD_PLACES = ["tel_aviv", "jerusalem", "center", "beer_sheva", "ashdod", "ashkelon", "sderot", "netivot", "holon", "rishon_lezion", "netanya", "petah_tikva", "raanana", "kfar_saba", "כפר_סבא", "bnei_brak", "בני_ברק", "ramat_gan", "hod_hasharon", "herzliya", "rehovot", "sharon", "shefela", "or_yehuda", "caesarea", "lod"]
GATE_GOOD_PLACE_TEXT = [r"חיפה|קריות|קריית\s*אתא|יקנעם|יוקנעם|נשר|טירת\s*כרמל|עכו|נהריה|כרמיאל|צפון|חדרה|יזרעאל|בית\s*שאן|remote|מרחוק"]
GATE_BAD_PLACE_TEXT = [
    r"אור\s*יהודה|קיסריה|לוד|ראשון\s*לציון|חולון|רמת\s*גן|תל\s*אביב|ירושלים|באר\s*שבע|שדרות|אשדוד|אשקלון|נתיבות|דרום",
    r"בני\s*ברק|כפר\s*סבא|פתח\s*תקווה|ראש\s*העין|מרכז\s*הארץ|איזור\s*המרכז|אזור\s*המרכז|השרון|שרון|השפלה|שפלה",
    r"tel\s*aviv|jerusalem|sderot|ashdod|ashkelon|beer\s*sheva|beersheba|bnei\s*brak|ramat\s*gan|petah\s*tikva|raanana|kfar\s*saba|hod\s*hasharon|hasharon|sharon|shefela|shfela|south|southern|central\s*israel",
]
CENTER_TEXT = [r"(?:^|[\s_-])(?:מרכז|center|centre|merkaz)(?:$|[\s_-])"]
MAIN_GOOD_PLACES = ["haifa", "krayot", "yokneam", "north", "remote", "nesher", "tirat_carmel", "nahariya", "acre", "karmiel"]
MAIN_BAD_PLACES = ["or_yehuda", "caesarea", "kesariya", "lod", "rishon_lezion", "holon", "ramat_gan", "tel_aviv", "jerusalem", "beer_sheva", "petah_tikva", "center", "ראש_העין", "אור_יהודה", "קיסריה", "לוד"]
MAIN_BAD_PLACE_TEXT = [
    r"אור\s*יהודה|קיסריה|לוד|ראשון\s*לציון|חולון|רמת\s*גן|תל\s*אביב|ירושלים|באר\s*שבע|שדרות|אשדוד|אשקלון|נתיבות|דרום|פתח\s*תקווה|ראש\s*העין|מרכז\s*הארץ|איזור\s*המרכז|אזור\s*המרכז|השרון|שרון|השפלה|שפלה",
    r"tel\s*aviv|jerusalem|sderot|ashdod|ashkelon|beer\s*sheva|beersheba|ramat\s*gan|petah\s*tikva|raanana|kfar\s*saba|hod\s*hasharon|hasharon|sharon|shefela|shfela|south|southern|central\s*israel",
]
#: The last fix of a scored posting blocks these as well.
FINAL_BAD_PLACE_TEXT = [*MAIN_BAD_PLACE_TEXT, r"בני\s*ברק|bnei\s*brak"]
BAD_LOCATION_LABELS = [r"סוג\s*משרה", r"היקף\s*משרה", "דרישות", r"תיאור\s*התפקיד"]
MAIN_BAD_LOCATION_LABELS = [r"סוג[_\s]*משרה", r"היקף[_\s]*משרה", "דרישות"]
GENERIC_PLACES = ["israel", "ישראל", "remote", "hybrid", "היברידי", "מרחוק"]

# --- companies ----------------------------------------------------------------------------------------

BAD_COMPANIES = ["Drushim", "AllJobs", "JobMaster", "Matrix", "SerpApi", "Israel", "ללא נסיון", "ללא ניסיון", "1-2 שנים", "2-3 שנים", "3-4 שנים", "משרה מלאה"]
BAD_COMPANY_TEXT = ["^(?:לפני|פורסם|דרוש|דרושה)$", "^#", r"position\s*:", r"display\s*:"]
CONFIDENTIAL_COMPANY = [r"חברה\s*חסויה|^חסויה$"]

# --- roles: the extractor -----------------------------------------------------------------------------

IRRELEVANT_ROLE = [r"אח/ות", "אחות", r"אח\s*מוסמך", "מרפאה", "חשבונות", "ייצור", "מכונאי", "צמ[\"״]?ה", r"טכנאי/ת\s*מכונות", r"הנדסאי/ת\s*מכונות", r"מהנדס/ת\s*מכונות", "שרטט", r"מתכנן/ת", "תשתיות", "מזון", "פיברו"]
JUNIOR = ["junior", "ג׳וניור", "ג'וניור", "ללא ניסיון", "ללא נסיון", r"entry\s*level"]
SENIOR_TITLE = ["senior", r"ראש\s*צוות", "ר[\"״]?צ", r"team\s*lead", r"tech\s*lead", r"lead\s+qa", r"qa\s+lead", "manager", "מנהל", "בכיר", "מנוסה"]
SENIOR_YEARS = [r"[345]\+?\s*שנים"]
QA_ROLE = [
    r"\bqa\b", r"quality\s*assurance", r"software\s*tester", r"system\s*tester", r"manual\s*tester", r"sw\s*qa", r"qa\s*tester", r"בודק\s*[/.]\s*ת\s*תוכנה", r"בודקי\s*תוכנה", r"בודקות\s*תוכנה",
    r"בודק(?:/ת)?\s*תוכנה", r"בודקת\s*תוכנה", r"בדיקות\s*תוכנה", r"בדיקות\s*ידניות", r"בדיקות\s*מערכת", r"בודק(?:/ת)?\s*qa", r"בודקת\s*qa", r"בודק(?:/ת)?\s*מערכתי", "stp", "std", "str",
    r"בודק(?:/ת)?\s*csv", r"בודק(?:/ת)?\s*erp", r"בדיקות\s*erp", r"בדיקות\s*csv", r"איכות\s*תוכנה", r"sw\s*test\s*engineer", r"software\s*quality", r"מהנדס(?:/ת)?\s*בדיקות", r"מהנדסת\s*בדיקות",
    r"בדיקות\s*web", r"בדיקות\s*mobile", r"web\s*/?\s*mobile", r"mobile\s*tester", r"web\s*tester",
]
MANUAL_ROLE = ["manual", "ידני"]
AUTOMATION_ROLE = ["automation", "אוטומציה", "selenium", "playwright", "cypress"]
IMPLEMENTER_ROLE = ["מטמיע", "הטמעה", "מיישם", "יישום", "מערכות מידע", "crm", "plm", "alm"]
APPLICATION_SUPPORT_ROLE = [r"application\s*support", r"תמיכה\s*אפליקטיבית"]
DATA_ENTRY_ROLE = [r"data\s*entry", r"הזנת\s*נתונים", r"קליטת\s*נתונים"]
DOCUMENT_ROLE = ["מידען", r"בקרת\s*מסמכים", r"document\s*control", r"doc\s*control", r"בק\s*אופיס", r"back\s*office", "אדמין", "אדמיניסטרציה"]
PHONE_ROLE = ["נציג", "מוקד", "טלפוני", r"שירות\s*לקוחות", r"call\s*center", r"customer\s*service"]
SALES_ROLE = ["מכירות", "sales"]
TRANSPORT_ROLE = [r"בטיחות\s*בתעבורה", r"צי\s*רכב", r"ניהול\s*רכב", "ליסינג", "נהג", "נהיגה"]

# --- signals ------------------------------------------------------------------------------------------

SHIFT_SIGNAL = ["משמרות", "לילות", "שבת", "חגים", r"סופי\s*שבוע", "כוננות", "shift", "night", "weekend"]
PHONE_SIGNAL = ["טלפוני", "מוקד", "שיחות", r"שירות\s*לקוחות", "נציג", r"call\s*center", r"customer\s*service"]
SENIOR_SIGNAL = ["senior", r"ראש\s*צוות", "ר[\"״]?צ", r"team\s*lead", "manager", "ניהול", "מנהל", "בכיר"]
SALES_SIGNAL = ["מכירות"]
NO_EXPERIENCE_SIGNAL = ["ללא ניסיון", "ללא נסיון", "junior", "ג׳וניור", "ג'וניור"]

# --- evidence for the gates ---------------------------------------------------------------------------

LETTER_BOUND_QA = r"(?:^|[^a-z])qa(?:$|[^a-z])"
SOFTWARE_TESTER_HE = r"בודק\s*[/.]?\s*(?:/ת|ת)?\s*תוכנה|בודק\.ת\s*תוכנה|בודקי\s*תוכנה|בודקות\s*תוכנה"
QA_TEXT = [LETTER_BOUND_QA, "tester|testing|test engineer|manual tester|system tester", r"v\s*&\s*v|v\s*v|verification|validation"]
QA_TITLE = [SOFTWARE_TESTER_HE, r"בדיקות\s*תוכנה|מהנדס(?:/ת)?\s*בדיקות|מהנדסת\s*בדיקות|בדיקות\s*ידניות|בדיקות\s*מערכת|בדיקות\s*שילובים"]
SOFTWARE_QA_TEXT = [
    r"תוכנה|software\s*quality", r"software\s*qa|sw\s*qa|software\s*tester|qa\s*tester|manual\s*tester|manual\s*qa|system\s*tester|software\s*testing|system\s*testing|test\s*plans|test\s*cases",
    r"sw\s*test\s*engineer|software\s*test\s*engineer|r&d\s*sw\s*test", r"test\s*automation|automation\s*qa|selenium|playwright|cypress", r"api\s*testing|web\s*testing|mobile\s*testing|בדיקות\s*web|בדיקות\s*mobile|web\s*/\s*mobile",
    r"crm|salesforce|sap|erp|priority|מערכות\s*מידע|אפליקטיבי|אפליקציה", r"stp|std|str|תסריטי\s*בדיקות|מסמכי\s*בדיקות",
]
SOFTWARE_QA_TITLE = [r"בדיקות\s*שילובים|בדיקות\s*מערכת|בודק(?:/ת)?\s*מערכתי"]
AUTOMATION_EVIDENCE = ["automation|אוטומציה|selenium|playwright|cypress"]
AUTOMATION_DEVELOPER = [r"מפתח(?:/ת)?\s*אוטומציה|automation\s*developer|develop\s*automation|פיתוח\s*אוטומציה"]
BUSINESS_QUALITY = ["איכות", "מפעל|ייצור|יצורי|אספטי|סטרילי", r"מכשור\s*רפואי|qa\s*/\s*ra|ra\s*/\s*qa|\bra\b|gmp|iso\s*13485", r"פארמה|תרופות|מעבדה|מזון|regulatory|רגולציה|quality\s*assurance|quality\s*control"]
INFORMATION_SYSTEMS = [r"מערכות\s*מידע|מטמיע|הטמעה|מיישם|יישום|crm|erp|sap|priority|salesforce|אפליקטיבי"]
DATA_OR_OFFICE = [r"data\s*entry|בק\s*אופיס|back\s*office|בקרת\s*מסמכים|document\s*control|מידען|אקסל|excel|קלדנות"]
GATE_HARD_EXCLUDE = [r"שירות\s*לקוחות|נציג|מוקד|טלפוני|שיחות|call\s*center|customer\s*service", r"מכירות|\bsales\b(?!\s*force)|business\s*development|account\s*executive", r"משמרות|לילות|סופי\s*שבוע|שבת|חגים|24/7|כוננות", r"תיירות|חופשות|נופש|הכנסה\s*גבוהה|רווחים\s*גבוהים"]
EXPERIENCE_WORD, YEARS_WORD = "(?:ניסיון|נסיון|experience)", "(?:שנים|שנות|שנה|years?|yrs?)"
FOUR_UP, THREE_UP = "(?:4|5|6|7|8|9|10)", "(?:3|4|5|6|7|8|9|10)"
GATE_SENIOR_TITLE = [r"ראש\s*צוות|ר[\"״]?צ|team\s*lead|\blead\b|manager|מנהל|בכיר|מומחה|מומחית|מנוסה"]
GATE_FOUR_YEARS = [rf"{FOUR_UP}\+?\s*{YEARS_WORD}", rf"{EXPERIENCE_WORD}.{{0,60}}{FOUR_UP}"]
GATE_THREE_YEARS = [rf"{THREE_UP}\+?\s*{YEARS_WORD}", rf"{EXPERIENCE_WORD}.{{0,60}}{THREE_UP}"]
#: The five seniority rules differ in words, years and distance; none replaces another.
SCORE_SENIOR_TITLE = [r"ראש\s*צוות|ר[\"״]?צ|team\s*lead|\blead\b|manager|cto|מנהל|בכיר"]
SCORE_FOUR_YEARS = [rf"{FOUR_UP}\+?\s*{YEARS_WORD}", rf"{EXPERIENCE_WORD}.{{0,50}}{FOUR_UP}"]
MAIN_FOUR_YEARS = [rf"{FOUR_UP}\+?\s*(?:שנים|שנות|years)", rf"{EXPERIENCE_WORD}.{{0,30}}{FOUR_UP}"]
FINAL_THREE_YEARS = [rf"{THREE_UP}\+?\s*{YEARS_WORD}", rf"{EXPERIENCE_WORD}.{{0,50}}{THREE_UP}", r"יותר\s*מדי\s*ני?סיון"]

# --- scoring ------------------------------------------------------------------------------------------

SCORE_HARD_EXCLUDE = [
    r"שירות\s*לקוחות|customer\s*(?:service|support)|support\s*representative|phone\s*support|call\s*center", "נציג", "מוקד|טלפוני|שיחות", "מכירות",
    r"משמרות|לילות|סופי\s*שבוע|שבת|חגים|כוננות|24/7", "תיירות|חופשות|נופש", r"רווחים\s*גבוהים|הכנסה\s*גבוהה", r"פנה(?:/י)?\s*ללא\s*קו[״\"]?ח",
]
CLERK = r"(?:^|[^\p{L}\p{N}])פקיד(?:ה|ת)?(?:$|[^\p{L}\p{N}])"
SCORE_OFFICE_NOISE = [CLERK, r"(?:^|[^\p{L}\p{N}])בק\s*אופיס(?:$|[^\p{L}\p{N}])", r"\bback\s*office\b", "לוגיסטיקה|מעבדה|פארמה|אצוות|מחסן|אדמיניסטרציה"]
MAIN_OFFICE_NOISE = [r"פקיד|בק\s*אופיס|back\s*office|לוגיסטיקה|מעבדה|פארמה|אצוות|מחסן|אדמיניסטרציה"]
JUNK_BUSINESS = [r"תיירות|חופשות|נופש|רווחים\s*גבוהים|הכנסה\s*גבוהה|פנה(?:/י)?\s*ללא\s*קו[״\"]?ח"]
QUIET_ROLE = [r"back\s*office|בק\s*אופיס|data\s*entry|הזנת\s*נתונים|קליטת\s*נתונים|document\s*control|doc\s*control|בקרת\s*מסמכים|מידען|information\s*specialist|application\s*support|תמיכה\s*אפליקטיבית"]
QUIET_FAMILIES = ["information", "operations", "analysis", "information_systems", "data"]
SOFTWARE_SIGNAL = [r"תוכנה|software|automation|automated|selenium|playwright|cypress|api|web|mobile|crm|salesforce|sap|erp|מערכות\s*מידע|system\s*qa|qa\s*tester|test\s*engineer"]
FACTORY_QUALITY = [r"הבטחת\s*איכות|בקרת\s*איכות|אבטחת\s*איכות", r"מפעל|ייצור|יצורי|אספטי|סטרילי|מכשור\s*רפואי|qa\s*/\s*ra|ra\s*/\s*qa|\bra\b|gmp|iso\s*13485|פארמה|תרופות|מעבדה|מזון|quality\s*assurance|quality\s*control|regulatory|רגולציה"]
PAID_ONLY = ["premium|פרימיום|למנויים בלבד|מנויים בלבד|מנוי בלבד|למנויי|דרוש חשבון|חשבון בתשלום|חשבון פרימיום"]
QA_WORDS = "(?:qa|בדיקות|בודק|בודקת|tester|testing)"
QA_AUTOMATION_TITLE = [f"{QA_WORDS}.*(?:automation|אוטומציה)", f"(?:automation|אוטומציה).*{QA_WORDS}"]
DEVELOPER_TITLE = [r"full\s*stack|software\s+developer|software\s+engineer|frontend|front\s*end|backend|back\s*end|\.net\s+developer|java\s+developer|react\s+developer|node(?:\.js)?\s+developer|מפתח(?:/ת)?\s*(?:תוכנה|full\s*stack|frontend|backend|front|react|\.net|מערכות מידע)|מתכנת"]
CLEAR_DEVELOPER_TITLE = [r"מפתח|developer|software\s*engineer|frontend|backend|full\s*stack"]
SPECIFIC_LEARNING = ["ניסיון|נסיון|מיקום|טלפוני|טלפון|שירות|לקוחות|מכירות|משמרות|שבת|חגים|בכיר|ניהולי|מרכז|תל אביב|ירושלים|שרון|שפלה"]
FINAL_QA_TITLE = [LETTER_BOUND_QA, "tester|testing|automation", SOFTWARE_TESTER_HE, r"בדיקות\s*תוכנה|איש\s*/אשת\s*qa|איש\s*qa|אשת\s*qa"]
FAMILY_POINTS = {"qa": 38, "information_systems": 26, "information": 16, "analysis": 28, "operations": 22}
FAMILY_REASONS = {
    "qa": "זוהה תפקיד QA / בדיקות תוכנה.",
    "information_systems": "זוהה תפקיד מערכות מידע / הטמעה.",
    "information": "תפקיד מידע / מסמכים — כיוון משני אפשרי.",
    "analysis": "זוהה תפקיד אנליטי מתאים.",
    "operations": "זוהה תפקיד תפעולי־טכני מתאים.",
}

# --- learning -----------------------------------------------------------------------------------------

ACTION_WEIGHTS = {"saved": 7, "applied": 14, "interview": 18, "deleted": -14, "skipped": -12, "rejected": -10, "not_relevant": -16}
#: reason: (label, penalty, patterns tested on the new posting)
REJECTION_REASONS = {
    "location": ("מיקום לא רלוונטי", -18, []),
    "shifts": ("משמרות / לילות / סופי שבוע", -18, ["משמרות", "לילות", r"סופי\s*שבוע", "סופש", "שבת", "חגים", "כוננות", "shift", "night", "weekend", "24/7"]),
    "phone": ("טלפוני מדי / מוקד", -18, ["טלפוני", "מוקד", "שיחות", "נציג", r"call\s*center"]),
    "customer_service": ("שירות לקוחות / תמיכה מדי", -18, [r"שירות\s*לקוחות", r"help\s*desk", r"customer\s*service", r"customer\s*support", r"phone\s*support", r"support\s*representative", r"נציג(?:/ת)?\s*תמיכה", r"תמיכה\s*טלפונית"]),
    "sales": ("מכירות / ביזנס מדי", -18, ["מכירות", "sales", r"account\s*executive", r"business\s*development", r"bd\b"]),
    "senior": ("בכיר / ניהולי מדי", -20, ["senior", r"team\s*lead", "manager", "director", "principal", r"ראש\s*צוות", "מנהל", "בכיר", "מנוסה", r"\b[3-9]\+?\s*(?:years|yrs)\b", r"[3-9]\s*שנים"]),
    "experience": ("דורש יותר מדי ניסיון", -18, [r"ניסיון\s*של\s*[3-9]", r"[3-9]\s*שנות\s*ניסיון", r"[3-9]\+\s*שנים", r"[3-9]\+?\s*(?:years|yrs)", r"לפחות\s*[3-9]\s*שנים"]),
    "wrong_role": ("סוג תפקיד לא מתאים", -16, []),
    "not_junior": ("לא מספיק ג׳וניור / לא כניסה", -16, ["senior", "middle", "מנוסה", r"לא\s*ג[׳']?וניור", r"ניסיון\s*חובה"]),
    "tech_stack": ("טכנולוגיות לא מתאימות", -12, []),
    "onsite": ("נוכחות במשרד / היברידי לא מתאים", -12, [r"משרה\s*מלאה\s*מהמשרד", r"עבודה\s*מהמשרד", "onsite", "on-site", r"5\s*ימים\s*מהמשרד"]),
    "already_applied": ("כבר שלחתי / כפילות", -8, []),
    "other": ("סיבה אחרת", -10, []),
}
SUPPORT_EVIDENCE = [r"application\s*support|תמיכה\s*אפליקטיבית"]
SERVICE_EVIDENCE = [r"שירות\s*לקוחות|customer\s*(?:service|support)|phone\s*support|call\s*center|help\s*desk|support\s*representative|נציג(?:/ת)?\s*תמיכה|תמיכה\s*טלפונית|מוקד|טלפוני|שיחות"]

# --- guards and statuses ------------------------------------------------------------------------------

PAGE_DUMP_SIGNALS = ["#backOverlay", "SearchResultsPopUp", "DisplayBnrOpenXScript", "google_tag_params", "googletagmanager", "lpTag", "דלג לתוכן ראשי", "כל הזכויות שמורות"]
GENERIC_TITLES = ["אבטחת איכות QA", "תוכנה", "QA תוכנה", "בדיקות תוכנה"]
NOISE_TITLES = ["משרות נוספות", "משרות דומות", "הגש מועמדות", "שמור למועדפים", "דרושים"]
MANUAL_FIELDS = ["status", "notes", "userNotes", "reviewNotes", "manualNotes", "rejectionReason", "rejectReason", "rejectedReason", "feedbackReason", "feedbackReasons", "manualReasons", "appliedAt", "rejectedAt", "archivedAt", "savedAt", "applicationStatus", "emailDraftId"]
STATUSES = ["found", "saved", "applied", "interview", "archived", "rejected", "skipped"]
POSITIVE_ACTIONS = ["saved", "applied", "interview"]
NEGATIVE_ACTIONS = ["deleted", "rejected", "skipped", "not_relevant"]

# --- results of the second provider's search, and their detail pages --------------------------------------

#: Words that show a wanted role, and those of them that a title must hold to be trusted.
TARGET_ROLE_WORDS = ["qa", "tester", "testing", "בודק", "בודקת", "בדיקות", "בדיק", "תוכנה", "אוטומציה", "automation", "web", "mobile", "data", "risk", "fraud", "מסמכים", "מערכות מידע", "מטמיע", "מיישם"]
STRONG_TITLE_WORDS = ["qa", "tester", "testing", "בודק", "בודקת", "בדיקות", "בדיק", "אוטומציה", "automation"]
QA_QUERY_WORDS = ["qa", "בדיקות", "בודק", "בודקת", "תוכנה"]
QA_RESULT_WORDS = ["qa", "tester", "testing", "בדיק", "בודק", "בודקת", "תוכנה", "web", "mobile", "אוטומציה"]
BAD_TITLE_WORDS = ["מיקום המשרה", "סוג משרה", "דרישות", "תיאור התפקיד", "חיפוש", "לוח משרות", "משרות מומלצות", "מילות מפתח", "שאלות הכנה", "שכר", "מאמרים", "הגש מועמדות", "שלח קורות חיים"]
RESULT_BAD_TITLES = ["בדיקת זכאות", "לעוד משרות ומידע", "כל התחומים", "טיפים וכתבות"]
RESULT_BAD_COMPANIES = ["AllCourses", "טיפים וכתבות", "כל התחומים"]
PAGE_NOISE_WORDS = ["משרות מומלצות", "חיפוש מתקדם", "לוח משרות", "מילות מפתח", "דרושים לפי תחום", "דרושים לפי אזור", "AllJobs", "תנאי שימוש", "מדיניות פרטיות"]
JOB_ID_PATTERNS = [r"[?&]jobid=(\d+)", r"jobid[\"'\s:=]+(\d+)", r"data-jobid=[\"']?(\d+)", r"data-job-id=[\"']?(\d+)"]
HIDDEN_COMPANY = "חברה חסויה"
NO_COMPANY_NAMES = ["AllJobs", "alljobs", "Full Time", "Part Time", "משרה מלאה", "משרה חלקית", "כל התחומים >>", "טיפים וכתבות", "and"]
NO_COMPANY_WORDS = ["AllCourses", "קורסים אונליין", "טיפים וכתבות", "כל התחומים"]
NO_COMPANY_TEXT = ["דרוש|דרושה|דרושים|דרוש/ה|בודק|בודקת|בדיקות|qa|tester|ניסיון|נסיון|במסגרת|התפקיד|תיאור|דרישות|משרה|מגייסת|מוביל|מובילה"]
COMPANY_LABELS, PLACE_LABELS = ["שם החברה", "חברה", "Company"], ["מיקום המשרה", "מיקום", "אזור", "איזור", "Location"]
TITLE_PARTS_DROPPED = ["תוכנה", "ניהול ביניים", "דרושים", "AllJobs"]
RESULT_PLACES = [
    "חיפה", "קריות", "יקנעם", "יוקנעם", "נשר", "טירת כרמל", "עכו", "נהריה", "כרמיאל", "צפון", "חיפה והקריות", "חיפה והצפון", "קרית ביאליק", "קריית ביאליק", "קרית אתא", "קריית אתא",
    "קרית מוצקין", "קריית מוצקין", "קרית ים", "קריית ים", "נתניה", "השרון", "רעננה", "פתח תקווה", "תל אביב", "מרכז", "אור יהודה", "קיסריה", "ראש העין", "לוד", "רמת גן", "חולון", "ראשון לציון",
]
#: English spellings of places, the first that is found counts.
PLACE_ALIASES = [("yokne'?am", "יקנעם"), ("haifa", "חיפה"), ("krayot", "קריות"), ("airport city", "איירפורט סיטי"), ("tel aviv", "תל אביב"), ("ramat gan", "רמת גן")]
PLACE_CUT = r"(?i)(סוג\s*משרה:?|סוגמשרה:?|היקף\s*משרה:?|היקףמשרה:?|תיאור\s*התפקיד:?|דרישות:?|Requirements|Job\s*Type|Show\s*more).*$"
DETAIL_PLACE_LABELS = [r"סוג\s*משרה|היקף\s*משרה|דרישות"]
COMPANY_AFTER_TITLE_BARRED = ["מיקום המשרה", "סוג משרה", "דרישות", "תיאור"]

# --- the mail agent ---------------------------------------------------------------------------------------

TOO_BROAD_TERMS = ["job", "jobs", "משרה", "משרות", "דרושים", "developer", "software", "תוכנה", "junior", "ללא ניסיון", "ללא נסיון"]
BROWSER_HOSTS = ["drushim.co.il", "alljobs.co.il", "comeet.com/jobs", "jobs.lever.co", "greenhouse.io"]
DEFAULT_MAIL_QUERY = "from:alljob.co.il OR from:drushim.co.il"
NO_SUBJECT, NO_SENDER = "מייל ללא כותרת", "שולח לא ידוע"
DEFAULT_QUERY_PLACES = ["חיפה", "צפון"]
PROFILE_MIN_SCORE, PROFILE_BONUS = 58.0, 28.0
DIGEST_TITLE = "^תקציר משרות לבדיקה:"
#: (name shown, what the source contains), first match counts.
SOURCE_LABELS = [("דרושים", "drushim"), ("AllJobs", "alljobs"), ("JobMaster", "jobmaster"), ("Matrix", "matrix"), ("אתרי מקור", "site")]
UNKNOWN_SOURCE_LABEL = "מקור לא ידוע"
STATUS_LABELS, NO_STATUS_LABEL = {"applied": "נשלח", "saved": "שמורה", "interview": "ראיון", "archived": "בארכיון", "rejected": "הוסרה", "skipped": "הוסרה"}, "טרם נשלח"
RECOMMENDATION_LABELS, REVIEW_LABEL = {"apply": "מומלץ לשלוח", "review": "צריך בדיקה", "skip": "לא מומלץ"}, "צריך בדיקה"
ROLE_LABELS, NO_ROLE_LABEL = [("אוטומציה", "automation"), ("בדיקות תוכנה", "qa"), ("מערכות מידע", "information_systems"), ("מידע ומסמכים", "information")], "תפקיד כללי"

# --- the digest of the third provider, anchored in lines ---------------------------------------------------

LINE_FOOTER = [r"משרות נוספות|לצפייה במשרה|לתצוגת כל המשרות|בואו לפגוש אותנו|youtube|linkedin|fb|google|apple|להסרה|דיוורים|unsubscribed@|דרושים\s*IL\s*-|מגשימים\s*1|פתח\s*תקווה"]
LINE_GREETING = ["^יש לנו בשבילך"]
LINE_SKIPPED = [r"^\d{2}/\d{2}/\d{4}$", "^המתאימות להגדרות שלך", "^התואמות להגדרות שלך", "^פורסמו בשעות האחרונות"]
LINE_JOB_TYPE = r"(?i)\s+(משרה מלאה|משרה חלקית|משמרות|עבודה היברידית|היברידית|עבודה מהבית|ללא ניסיון|ללא נסיון|אקדמאים ללא ניסיון|סטודנטים|1-2 שנים|2-3 שנים|3-4 שנים|4-5 שנים|5\+ שנים|זמנית|קבועה).*$"
LINE_PLACES = "חיפה|קריית ביאליק|קרית ביאליק|קריית אתא|קרית אתא|בני ברק|עכו|כרמיאל|נשר|יקנעם|יוקנעם|קריות|צפון|גליל|תל אביב|רמת גן|פתח תקווה|פתח תקוה|לוד|Remote|מרחוק"
LINE_NEW_ALERT = [r"משרות חדשות שפורסמו|יש לנו בשבילך\s+\d+\s+משרות חדשות|התואמות להגדרות שלך|המתאימות להגדרות שלך|פורסמו בשעות האחרונות"]
LINE_BAD_ANCHOR = ["youtube|linkedin|facebook|fb|google|apple|unsubscribe|unsubscribed|הסרה|להסרה|הסר|דיוורים|privacy|terms|בואו לפגוש|לתצוגת כל המשרות|משרות נוספות"]
LINE_BUTTONS = ["^(youtube|linkedin|fb|google|apple|link)$", "משרות נוספות|לצפייה במשרה|לתצוגת כל המשרות|בואו לפגוש"]
LINE_TITLE_WORDS = r"דרוש|דרושה|דרוש/ה|מיישם|מטמיע|בודק|בודקת|QA|Test|Supervisor|כלכלן|כלכלנית|מפתח|מפתחת|אוטומציה|מערכות|תוכנה|Help\s*desk|Data|Back\s*Office|Developer|Engineer|כתב|כתבת|מדריך|מדריכה|טכני|טכנית"

# --- result pages: what is cut from a card's lines, and where cards are looked for -------------------------

UI_LINES = [
    "הגש מועמדות", "הגשת מועמדות", "עדכון קורות החיים", "שמירת משרה", "ביטול שמירה", "מחיקת משרה", "ביטול מחיקה", "שלח לחבר", "שתף", "התחברות", "הרשמה", "משרות שלי", "חיפוש עבודה", "דרושים", "AllJobs",
    "לוח משרות", "משרות מומלצות", "משרות חמות", "מילות מפתח", "חיפוש מתקדם", "שאלות הכנה", "שכר", "מאמרים", "עוד...", "Image:", "VIP",
]
ANCESTOR_CARDS = ["[data-jobid]", "[data-job-id]", "article", "li", "[class*='job']", "[class*='Job']", "[id*='job']", "[id*='Job']", "[class*='card']", "[class*='result']", "div"]
SWEPT_CARDS = ["[data-jobid]", "[data-job-id]", "article", "li", "[class*='job']", "[class*='Job']", "[id*='job']", "[id*='Job']", "[class*='result']"]
ANCESTOR_CARD_LENGTH, SWEPT_CARD_LENGTH = (40, 3500), (60, 3500)
CHUNK_BORDER = r"לפני \d+ שעות|לפני \d+ ימים|לפני יום|לפני \d+ דקות"
