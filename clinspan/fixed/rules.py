"""Clinical rule tables: thresholds, interactions, recommendations, quality measures.

FIXED VALUES: thresholds, drug pairs and sentences must equal the published rule set, so they are
stated here as plain rows in their natural order.
"""

# lab, low, high, unit; limits as they are printed (some whole numbers carry no decimal point)
CRITICAL_LABS = [
    ("hemoglobin", "7.0", "20.0", "g/dL"),
    ("potassium", "2.5", "6.5", "mEq/L"),
    ("sodium", "120", "160", "mEq/L"),
    ("glucose", "50", "500", "mg/dL"),
    ("creatinine", None, "10.0", "mg/dL"),
    ("platelets", "20", None, "10*9/L"),
]

# drug, drug, warning
DRUG_PAIRS = [
    ("warfarin", "aspirin", "Increased bleeding risk with concurrent anticoagulant/antiplatelet therapy"),
    ("metformin", "creatinine_high", "Metformin contraindicated in severe renal impairment"),
    ("tacrolimus", "potassium_high", "Tacrolimus can exacerbate hyperkalemia"),
    ("warfarin", "nsaid", "NSAIDs increase bleeding risk with warfarin - consider alternative analgesic"),
    ("warfarin", "ibuprofen", "Ibuprofen increases bleeding risk with warfarin"),
    ("aspirin", "ibuprofen", "Concurrent NSAIDs increase GI bleeding risk"),
    ("lisinopril", "potassium", "ACE inhibitors + potassium supplements risk hyperkalemia"),
    ("lisinopril", "spironolactone", "ACE inhibitors + K-sparing diuretics risk severe hyperkalemia"),
    ("methotrexate", "nsaid", "NSAIDs reduce methotrexate clearance - toxicity risk"),
    ("methotrexate", "ibuprofen", "Ibuprofen reduces methotrexate clearance - toxicity risk"),
    ("digoxin", "amiodarone", "Amiodarone increases digoxin levels - monitor closely"),
    ("simvastatin", "clarithromycin", "Macrolides increase statin levels - myopathy risk"),
    ("atorvastatin", "clarithromycin", "Macrolides increase statin levels - myopathy risk"),
    ("lithium", "nsaid", "NSAIDs reduce lithium clearance - toxicity risk"),
    ("lithium", "ibuprofen", "Ibuprofen reduces lithium clearance - toxicity risk"),
    ("oxycodone", "lorazepam", "Opioid + benzodiazepine: respiratory depression risk"),
    ("morphine", "lorazepam", "Opioid + benzodiazepine: respiratory depression risk"),
    ("fentanyl", "midazolam", "Opioid + benzodiazepine: respiratory depression risk"),
    ("fluoxetine", "tramadol", "SSRI + tramadol: serotonin syndrome risk"),
    ("sertraline", "tramadol", "SSRI + tramadol: serotonin syndrome risk"),
    ("metoprolol", "verapamil", "Beta-blocker + CCB: severe bradycardia/heart block risk"),
    ("sildenafil", "nitroglycerin", "PDE5 inhibitor + nitrates: severe hypotension - contraindicated"),
    ("ciprofloxacin", "antacid", "Antacids reduce fluoroquinolone absorption - separate doses"),
    ("levothyroxine", "calcium", "Calcium reduces levothyroxine absorption - separate doses"),
]

# RxNorm code -> name used by the drug rules; other codes stay as they are
RULE_DRUG_NAMES = [
    ("11289", "warfarin"), ("1191", "aspirin"), ("860975", "metformin"), ("42316", "tacrolimus"),
]

DRUG_PAIR_ACTIONS = [
    "Review medication necessity", "Consider alternative therapy", "Monitor for adverse effects",
]
METFORMIN_ACTIONS = [
    "Review metformin necessity", "Calculate eGFR", "Consider dose adjustment or alternative",
]
METFORMIN_TEXT = (
    "Metformin may be contraindicated due to elevated creatinine suggesting renal impairment"
)
DIABETES_GAP_ACTIONS = [
    "Review diabetes management plan", "Consider medication intensification",
    "Reinforce lifestyle modifications", "Schedule follow-up for reassessment",
]
DIABETES_GOAL_ACTIONS = ["Continue current management"]
EMERGENCY_ACTIONS = [
    "Review for care coordination opportunities",
    "Consider chronic disease management enrollment",
    "Evaluate for social determinants of health",
]
INPATIENT_ACTIONS = [
    "Review for readmission prevention opportunities",
    "Consider transitional care management",
    "Evaluate medication reconciliation",
]

# LOINC code -> lab name shown in insights
LAB_NAMES = [
    ("718-7", "Hemoglobin"), ("6690-2", "White blood cell count"), ("777-3", "Platelet count"),
    ("2160-0", "Creatinine"), ("3094-0", "Blood urea nitrogen"), ("2345-7", "Glucose"),
    ("4548-4", "HbA1c"), ("2951-2", "Sodium"), ("2823-3", "Potassium"), ("1742-6", "ALT"),
    ("1920-8", "AST"), ("1975-2", "Bilirubin (total)"), ("1751-7", "Albumin"),
    ("5902-2", "Prothrombin time"), ("6301-6", "INR"),
]

MIN_TREND_LENGTH = 3

# lab name (lower case), direction, actions
TREND_ACTIONS = [
    ("creatinine", "rising", [
        "Assess renal function — calculate/trend eGFR",
        "Review nephrotoxic agents and contrast exposure",
        "Consider nephrology referral if progressive"]),
    ("creatinine", "declining", [
        "Confirm recovering renal function and adequate hydration",
        "Re-evaluate renally-cleared drug dosing"]),
    ("hemoglobin", "declining", [
        "Evaluate for occult blood loss or hemolysis",
        "Check iron studies and reticulocyte count",
        "Assess transfusion need if symptomatic or <7 g/dL"]),
    ("hemoglobin", "rising", [
        "Reassess hydration/volume status",
        "Consider polycythemia work-up if persistently elevated"]),
    ("white blood cell count", "rising", [
        "Evaluate for infection or inflammatory process",
        "Correlate with cultures, fever curve and clinical exam"]),
    ("white blood cell count", "declining", [
        "Assess for marrow suppression or drug effect",
        "Monitor CBC closely; review myelosuppressive medications"]),
    ("glucose", "rising", [
        "Review glycemic control and adjust diabetes therapy",
        "Obtain HbA1c to assess longer-term control"]),
    ("glucose", "declining", [
        "Assess for over-treatment / hypoglycemia risk",
        "Review insulin and oral hypoglycemic dosing"]),
    ("potassium", "rising", [
        "Review potassium-retaining drugs (ACEi/ARB, K-sparing diuretics)",
        "Obtain ECG if markedly elevated"]),
    ("potassium", "declining", [
        "Evaluate for GI/renal losses; consider repletion"]),
    ("platelet count", "declining", [
        "Work up thrombocytopenia (drug-induced, consumptive, marrow)",
        "Hold agents affecting platelets where appropriate"]),
    ("hba1c", "rising", [
        "Intensify diabetes management plan",
        "Reinforce lifestyle modification and adherence"]),
]

# lab, direction, actions
CRITICAL_ACTIONS = [
    ("hemoglobin", "low", [
        "Assess for active bleeding; type & screen",
        "Check iron studies; transfuse per protocol if symptomatic"]),
    ("potassium", "high", [
        "Obtain stat ECG; institute hyperkalemia protocol if changes",
        "Hold ACEi/ARB and potassium-sparing agents"]),
    ("potassium", "low", [
        "Replete potassium; check magnesium concurrently",
        "Review diuretic therapy"]),
    ("sodium", "high", [
        "Assess free-water deficit and volume status",
        "Correct hypernatremia at a safe rate"]),
    ("sodium", "low", [
        "Determine volume status and serum osmolality",
        "Correct sodium slowly to avoid osmotic demyelination"]),
    ("glucose", "high", [
        "Check ketones/anion gap; treat hyperglycemia",
        "Review insulin regimen and triggers"]),
    ("glucose", "low", [
        "Treat hypoglycemia immediately (oral/IV glucose)",
        "Identify and remove the precipitating cause"]),
    ("creatinine", "high", [
        "Work up acute kidney injury (pre/intra/post-renal)",
        "Hold nephrotoxins; renally dose medications"]),
    ("platelets", "low", [
        "Assess bleeding risk and hold anticoagulation if needed",
        "Work up thrombocytopenia; consider hematology input"]),
]
CRITICAL_CONFIRM = "Confirm with a repeat measurement before acting"

# measure key, name, description, target, condition substrings, evidence table, evidence substrings
QUALITY_MEASURES = [
    ("diabetes_hba1c_monitoring", "Diabetes HbA1c Monitoring",
     "% of diabetic patients with HbA1c documented", 90,
     ["diabetes", "e11"], "measurement", ["hba1c", "4548-4"]),
    ("hypertension_bp_control", "Hypertension BP Control",
     "% of hypertensive patients with BP < 140/90", 70,
     ["hypertension", "i10"], "measurement_below_140", ["systolic"]),
    ("ckd_monitoring", "CKD Monitoring",
     "% of CKD patients with eGFR/creatinine monitoring", 85,
     ["chronic kidney", "ckd", "n18"], "measurement", ["egfr", "creatinine"]),
    ("heart_failure_acei", "Heart Failure ACE/ARB Therapy",
     "% of HF patients on ACE inhibitor or ARB", 80,
     ["heart failure", "i50"], "drug",
     ["lisinopril", "enalapril", "ramipril", "losartan", "valsartan"]),
]

STUDY_ANALYSES = ["Outcomes analysis", "Treatment pattern analysis", "Risk factor identification"]
IMPROVEMENT_ANALYSES = [
    "Care gap closure intervention", "Best practice implementation", "Outcome measurement",
]
