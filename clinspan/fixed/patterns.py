"""Regular expressions, identifier types and known names.

FIXED VALUES: patterns, labels and their order must equal the published rule set (an earlier
pattern wins over a later one), so they are stated here as plain rows.
"""

# note redaction: pattern, replacement, in the order they are applied
NOTE_REDACTIONS = [
    (r"\b[A-Z][a-z]+ [A-Z][a-z\-]+\b", "[NAME]"),
    (r"\b\d{10}\b", "[ID]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\bDr\.\s*[A-Z][a-z]+\s*[A-Z][a-z\-]+\b", "[PROVIDER]"),
    (r"\bMRN[-:]?\s*\w+\b", "[MRN]"),
    (r"\b\d{1,5}\s+[A-Za-z]+\s+(Street|St|Road|Rd|Avenue|Ave)\b", "[ADDRESS]"),
]

# identifier types in their declared order, with the mask that replaces a detection
PHI_MASKS = [
    ("name", "[PATIENT NAME]"), ("geographic", "[ADDRESS]"), ("dob", "[DOB]"),
    ("phone", "[PHONE]"), ("fax", "[FAX]"), ("email", "[EMAIL]"), ("ssn", "[SSN]"),
    ("mrn", "[MRN]"), ("health_plan_id", "[HEALTH PLAN ID]"), ("account_number", "[ACCOUNT]"),
    ("license_number", "[LICENSE]"), ("vehicle_id", "[VEHICLE ID]"),
    ("device_id", "[DEVICE ID]"), ("url", "[URL]"), ("ip_address", "[IP ADDRESS]"),
    ("biometric", "[BIOMETRIC]"), ("photo", "[PHOTO]"), ("unique_id", "[UNIQUE ID]"),
]

KNOWN_NAME_CONFIDENCE = 0.99
PHI_CONFIDENCE = 0.85

# identifier type, pattern, in detection order
PHI_PATTERNS = [
    ("name", r'\b(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Miss)\s+[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b'),
    ("name", r'\b[A-Z][a-z]+,\s+[A-Z][a-z]+(?:\s+[A-Z]\.?)?\b'),
    ("name", r'\b[A-Z][a-z]+\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+(?:-[A-Z][a-z]+)?\b'),
    ("geographic", r'\b\d{1,5}\s+[A-Za-z]+(?:\s+[A-Za-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Way|Boulevard|Blvd|Court|Ct)\b'),
    ("geographic", r'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b'),
    ("geographic", r'\b\d{5}(?:-\d{4})?\b'),
    ("dob", r'\b(?:DOB|Date of Birth|Birth Date|Born|D\.O\.B\.?)[:\s]+(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b'),
    ("dob", r'\b(?:DOB|Date of Birth|Birth Date|Born|D\.O\.B\.?)[:\s]+(?:19|20)\d{2}[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12]\d|3[01])\b'),
    ("dob", r'\b(?:DOB|Date of Birth|Birth Date|Born|D\.O\.B\.?)[:\s]+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b'),
    ("dob", r'\b(?:age|aged?)\s*[:\s]?\s*(?:9\d|1\d{2})\s*(?:years?|yrs?|y\.?o\.?)?\b'),
    ("phone", r'\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b'),
    ("phone", r'\b\d{3}[-.\s]\d{4}\b'),
    ("phone", r'\b\+966\s?\d{1,2}\s?\d{3}\s?\d{4}\b'),
    ("phone", r'\b\+966\s?\d{9}\b'),
    ("fax", r'\b(?:fax|facsimile)[:\s]+(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b'),
    ("email", r'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'),
    ("ssn", r'\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b'),
    ("ssn", r'\bSSN[:\s]+\d{3}[-\s]?\d{2}[-\s]?\d{4}\b'),
    ("ssn", r'\b(?:National ID|Iqama|ID)[:\s()]*\d{10}\b'),
    ("ssn", r'\b[12]\d{9}\b'),
    ("mrn", r'\b(?:MRN|Medical Record Number|Patient ID|Record #)[:\s]+[A-Z0-9-]+\b'),
    ("mrn", r'\b[A-Z]{2,4}[-]?\d{6,10}\b'),
    ("health_plan_id", r'\b(?:Health Plan|Insurance|Member|Subscriber)\s*(?:ID|#|Number)[:\s]+[A-Z0-9-]+\b'),
    ("health_plan_id", r'\b(?:Policy|Group)\s*(?:#|Number)[:\s]+[A-Z0-9-]+\b'),
    ("account_number", r'\b(?:Account|Acct)\s*(?:#|Number)[:\s]+\d+\b'),
    ("account_number", r'\b(?:Billing|Invoice)\s*(?:#|Number)[:\s]+[A-Z0-9-]+\b'),
    ("license_number", r'\b(?:License|Licence|DEA|NPI)\s*(?:#|Number)[:\s]+[A-Z0-9-]+\b'),
    ("license_number", r'\b(?:Driver.?s?\s+License)[:\s]+[A-Z0-9-]+\b'),
    ("vehicle_id", r'\b(?:VIN|Vehicle)[:\s]+[A-Z0-9]{17}\b'),
    ("vehicle_id", r'\b(?:License Plate|Plate)[:\s]+[A-Z0-9-]+\b'),
    ("device_id", r'\b(?:Device|Serial)\s*(?:#|Number|ID)[:\s]+[A-Z0-9-]+\b'),
    ("device_id", r'\b(?:IMEI|MAC)[:\s]+[A-Z0-9:.-]+\b'),
    ("url", r'\bhttps?://[^\s<>"{}|\\^`\[\]]+\b'),
    ("url", r'\bwww\.[^\s<>"{}|\\^`\[\]]+\b'),
    ("ip_address", r'\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b'),
    ("ip_address", r'\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b'),
    ("biometric", r'\b(?:fingerprint|retina|iris|voiceprint|face\s+recognition)\b'),
    ("unique_id", r'\b[A-F0-9]{8}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{12}\b'),
]

# Two of the patterns above repeat a group of words. The regex engine recurses once per repetition, so
# a long text without punctuation would exhaust its stack. These forms give the same matches:
# words and blanks as one character class, and a word run that never gives a word back (nothing
# but its end can precede the comma). The second is only tried on texts that hold its tail at all.
PHI_FLAT_FORMS = {
    PHI_PATTERNS[3][1]: r'\b\d{1,5}\s+[A-Za-z][A-Za-z\s]*\s(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Way|Boulevard|Blvd|Court|Ct)\b',
    PHI_PATTERNS[4][1]: r'\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++)*+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b',
}
PHI_REQUIRED_TAILS = {PHI_PATTERNS[4][1]: r',\s*[A-Z]{2}\s+\d{5}'}

# Literal parts (lower case) without which a pattern cannot match, by its place in PHI_PATTERNS; a
# text holding none of them is not searched for that pattern.
PHI_NEEDS = {
    0: ["dr", "mr", "ms", "miss"],
    1: [","],
    3: ["st", "ave", "road", "rd", "dr", "lane", "ln", "way", "blvd", "boulevard", "court", "ct"],
    6: ["dob", "birth", "born", "d.o.b"], 7: ["dob", "birth", "born", "d.o.b"], 8: ["dob", "birth", "born", "d.o.b"],
    9: ["age"],
    12: ["+966"], 13: ["+966"], 14: ["fax", "facsimile"], 15: ["@"], 17: ["ssn"], 18: ["id", "iqama"],
    20: ["mrn", "medical record", "patient id", "record #"],
    22: ["health plan", "insurance", "member", "subscriber"], 23: ["policy", "group"],
    24: ["account", "acct"], 25: ["billing", "invoice"], 26: ["license", "licence", "dea", "npi"],
    27: ["driver"], 28: ["vin", "vehicle"], 29: ["plate"], 30: ["device", "serial"], 31: ["imei", "mac"],
    32: ["://"], 33: ["www."], 34: ["."], 35: [":"],
    36: ["fingerprint", "retina", "iris", "voiceprint", "face"], 37: ["-"],
}
# Characters one of which a pattern starts with, by its place. Looking at the next character is far cheaper than
# trying a word border, so a place without one is passed over at once. Matches stay the same.
PHI_FIRST = {
    0: "dm", 3: r"\d", 5: r"\d", 6: "bd", 7: "bd", 8: "bd", 9: "a", 10: r"+(\d", 11: r"\d", 12: "+", 13: "+", 14: "f", 16: r"\d",
    17: "s", 18: "in", 19: "12", 20: "mpr", 22: "hims", 23: "gp", 24: "a", 25: "bi", 26: "dln", 27: "d", 28: "v", 29: "lp",
    30: "ds", 31: "im", 32: "h", 33: "w", 34: r"\d", 35: "0-9a-f", 36: "firv", 37: "0-9a-f",
}
# digits in a row that a pattern needs, by its place
PHI_NEEDS_DIGITS = {4: 5, 5: 5, 6: 4, 7: 4, 8: 4, 10: 4, 11: 4, 12: 4, 13: 9, 14: 4, 16: 4, 17: 4, 18: 10, 19: 10, 21: 6}
# a short part that every match of a pattern holds, by its place: rarer than what the pattern starts with, so far cheaper to look for
PHI_NEEDS_PART = {
    1: r",\s+[A-Z]", 9: r"9\d|1\d{2}", 22: "#|ID|Number", 23: "#|Number", 24: "#|Number", 25: "#|Number", 26: "#|Number",
    27: "License", 30: "#|ID|Number", 34: r"\d\.\d", 35: ":[0-9a-f]{1,4}:", 37: "-[0-9a-f]{4}-",
}

# clinical entity class, confidence, pattern, in extraction order
ENTITY_PATTERNS = [
    ("medication", 0.9, r'\b(metformin|lisinopril|atorvastatin|aspirin|amlodipine|carvedilol|furosemide|warfarin|apixaban|clopidogrel|heparin|morphine|omeprazole|nitroglycerin|insulin|ondansetron)\b'),
    ("medication", 0.9, r'\b(Glucophage|Lipitor|Norvasc|Coreg|Lasix|Coumadin|Eliquis|Plavix|Prilosec|Lantus|Humalog|Zofran)\b'),
    ("medication", 0.9, r'\b\d+\s*(?:mg|mcg|mL|units?)\s+(?:of\s+)?[A-Za-z]+\b'),
    ("condition", 0.85, r'\b(myocardial infarction|heart attack|MI|STEMI|NSTEMI|acute coronary syndrome|ACS)\b'),
    ("condition", 0.85, r'\b(type 2 diabetes|T2DM|diabetes mellitus|diabetic)\b'),
    ("condition", 0.85, r'\b(hypertension|HTN|high blood pressure|elevated blood pressure)\b'),
    ("condition", 0.85, r'\b(heart failure|CHF|congestive heart failure|HF)\b'),
    ("condition", 0.85, r'\b(atrial fibrillation|AFib|A-fib|AF)\b'),
    ("condition", 0.85, r'\b(COPD|chronic obstructive pulmonary disease)\b'),
    ("condition", 0.85, r'\b(chronic kidney disease|CKD|renal failure|ESRD)\b'),
    ("condition", 0.85, r'\b(pneumonia|sepsis|stroke|CVA|pulmonary embolism|PE|DVT)\b'),
    ("condition", 0.85, r'\b(hyperlipidemia|dyslipidemia|hypercholesterolemia)\b'),
    ("condition", 0.85, r'\b(coronary artery disease|CAD|ischemic heart disease)\b'),
    ("symptom", 0.8, r'\b(chest pain|dyspnea|shortness of breath|SOB|breathlessness)\b'),
    ("symptom", 0.8, r'\b(fever|pyrexia|headache|nausea|vomiting|diarrhea)\b'),
    ("symptom", 0.8, r'\b(abdominal pain|fatigue|dizziness|syncope|palpitations)\b'),
    ("symptom", 0.8, r'\b(edema|swelling|cough|weakness)\b'),
    ("procedure", 0.85, r'\b(electrocardiogram|ECG|EKG|12-lead)\b'),
    ("procedure", 0.85, r'\b(echocardiogram|echo|TTE|TEE)\b'),
    ("procedure", 0.85, r'\b(cardiac catheterization|cath|angiogram|angiography)\b'),
    ("procedure", 0.85, r'\b(chest X-ray|CXR|chest radiograph)\b'),
    ("procedure", 0.85, r'\b(CT scan|computed tomography|CAT scan)\b'),
    ("procedure", 0.85, r'\b(MRI|magnetic resonance)\b'),
    ("procedure", 0.85, r'\b(intubation|ventilator|mechanical ventilation)\b'),
    ("procedure", 0.85, r'\b(central line|arterial line|IV|intravenous)\b'),
    ("procedure", 0.85, r'\b(PCI|stent|angioplasty|CABG)\b'),
    ("lab_test", 0.85, r'\b(troponin|hs-troponin|cardiac enzymes)\b'),
    ("lab_test", 0.85, r'\b(HbA1c|hemoglobin A1c|glycated hemoglobin)\b'),
    ("lab_test", 0.85, r'\b(LDL|HDL|cholesterol|triglycerides|lipid panel)\b'),
    ("lab_test", 0.85, r'\b(creatinine|BUN|GFR|eGFR|kidney function)\b'),
    ("lab_test", 0.85, r'\b(CBC|complete blood count|hemoglobin|hematocrit|WBC|platelets)\b'),
    ("lab_test", 0.85, r'\b(sodium|potassium|chloride|BMP|CMP|electrolytes)\b'),
    ("lab_test", 0.85, r'\b(AST|ALT|liver function|LFT|bilirubin)\b'),
    ("lab_test", 0.85, r'\b(glucose|blood sugar|fasting glucose)\b'),
    ("lab_test", 0.85, r'\b(INR|PT|PTT|coagulation)\b'),
    ("lab_test", 0.85, r'\b(BNP|NT-proBNP)\b'),
    ("vital_sign", 0.9, r'\b(blood pressure|BP|systolic|diastolic)\s*:?\s*(\d{2,3})/(\d{2,3})\b'),
    ("vital_sign", 0.9, r'\b(heart rate|HR|pulse)\s*:?\s*(\d{2,3})\s*(?:bpm|/min)?\b'),
    ("vital_sign", 0.9, r'\b(temperature|temp)\s*:?\s*(\d{2,3}\.?\d?)\s*(?:F|C|degrees?)?\b'),
    ("vital_sign", 0.9, r'\b(respiratory rate|RR|resp)\s*:?\s*(\d{1,2})\s*(?:/min)?\b'),
    ("vital_sign", 0.9, r'\b(oxygen saturation|O2 sat|SpO2|sat)\s*:?\s*(\d{2,3})%?\b'),
    ("vital_sign", 0.9, r'\b(weight)\s*:?\s*(\d{2,3}\.?\d?)\s*(?:kg|lbs?|pounds?)?\b'),
    ("vital_sign", 0.9, r'\b(height)\s*:?\s*(\d{1,3}\.?\d?)\s*(?:cm|m|ft|inches?)?\b'),
]
ENTITY_CONTEXT_CHARS = 50

# Literal parts without which the patterns that are not plain word lists cannot match, by place
ENTITY_NEEDS = {
    2: ["mg", "mcg", "ml", "unit"], 36: ["blood pressure", "bp", "systolic", "diastolic"],
    37: ["heart rate", "hr", "pulse"], 38: ["temp"], 39: ["resp", "rr"], 40: ["sat", "spo2"],
    41: ["weight"], 42: ["height"],
}

# lab alias -> LOINC short name
LAB_ALIASES = [
    ("troponin", "troponin i cardiac"), ("troponin i", "troponin i cardiac"),
    ("hs-troponin", "hs-troponin i"), ("hba1c", "hba1c"), ("hemoglobin a1c", "hba1c"),
    ("a1c", "hba1c"), ("ldl", "ldl cholesterol"), ("hdl", "hdl cholesterol"),
    ("total cholesterol", "total cholesterol"), ("cholesterol", "total cholesterol"),
    ("triglycerides", "triglycerides"), ("creatinine", "creatinine"), ("bun", "bun"),
    ("egfr", "egfr"), ("gfr", "egfr"), ("glucose", "glucose"), ("blood sugar", "glucose"),
    ("hemoglobin", "hemoglobin"), ("hematocrit", "hematocrit"), ("wbc", "wbc"),
    ("white blood cell", "wbc"), ("platelets", "platelets"), ("sodium", "sodium"),
    ("potassium", "potassium"), ("chloride", "chloride"), ("ast", "ast"), ("alt", "alt"),
    ("blood pressure", "sbp"), ("systolic", "sbp"), ("diastolic", "dbp"),
    ("heart rate", "heart rate"), ("pulse", "heart rate"), ("temperature", "temperature"),
    ("respiratory rate", "resp rate"), ("oxygen saturation", "spo2"), ("spo2", "spo2"),
    ("o2 sat", "spo2"),
]
DOSE_TAIL = r'\s*\d+\s*(mg|mcg|ml|units?|g)\b.*'
