"""Concept maps, enumerations and export column orders.

FIXED VALUES: codes, ids, names and aliases must equal the published mapping tables, so they are
stated here as plain rows in their natural order.
"""

# CDM type concepts: the provenance id written on every row of a table
VISIT_TYPE_CONCEPT = 44818518
CONDITION_TYPE_CONCEPT = 32817
MEASUREMENT_TYPE_CONCEPT = 44818702
DRUG_TYPE_CONCEPT = 38000177

# gender value -> concept id
GENDER_CONCEPTS = [("male", 8507), ("female", 8532), ("other", 8551), ("unknown", 8551)]
UNKNOWN_GENDER_CONCEPT = 8551
# gender concept id -> label
GENDER_LABELS = [(8507, "Male"), (8532, "Female"), (8551, "Unknown")]

# encounter type -> visit concept id
VISIT_CONCEPTS = [("inpatient", 9201), ("outpatient", 9202), ("emergency", 9203), ("icu", 32037)]
DEFAULT_VISIT_CONCEPT = 9202

# ICD-10 code -> SNOMED concept id, name
ICD_TO_SNOMED = [
    ("C91.0", 93143009, "Acute lymphoid leukemia"),
    ("C50.9", 254837009, "Malignant neoplasm of breast"),
    ("N18.9", 709044004, "Chronic kidney disease"),
    ("E11.9", 44054006, "Type 2 diabetes mellitus"),
    ("I10", 38341003, "Hypertensive disorder"),
    ("I25.10", 53741008, "Coronary arteriosclerosis"),
    ("I50.9", 84114007, "Heart failure"),
    ("K74.60", 19943007, "Cirrhosis of liver"),
    ("N18.6", 46177005, "End-stage renal disease"),
    ("D57.1", 417357006, "Sickle cell disease"),
    ("D56.1", 40108008, "Thalassemia major"),
    ("C22.0", 25370001, "Hepatocellular carcinoma"),
    ("C18.9", 363406005, "Malignant neoplasm of colon"),
    ("C85.9", 118601006, "Non-Hodgkin lymphoma"),
    ("C90.0", 109989006, "Multiple myeloma"),
    ("Z94.81", 234519009, "Bone marrow transplant"),
    ("Z94.0", 70536003, "Kidney transplant"),
    ("Z94.4", 18027006, "Liver transplant"),
    ("J18.9", 233604007, "Pneumonia"),
    ("A41.9", 91302008, "Sepsis"),
    ("N17.9", 14669001, "Acute kidney injury"),
    ("I63.9", 230690007, "Stroke"),
    ("I21.9", 22298006, "Myocardial infarction"),
    ("I26.99", 59282003, "Pulmonary embolism"),
    ("I82.40", 128053003, "Deep vein thrombosis"),
]

# LOINC code -> measurement concept id, name
LOINC_CONCEPTS = [
    ("718-7", 3000963, "Hemoglobin"),
    ("6690-2", 3010813, "White blood cell count"),
    ("777-3", 3024929, "Platelet count"),
    ("2160-0", 3016723, "Creatinine"),
    ("3094-0", 3013682, "Blood urea nitrogen"),
    ("2345-7", 3004501, "Glucose"),
    ("4548-4", 3004410, "Hemoglobin A1c"),
    ("2951-2", 3019550, "Sodium"),
    ("2823-3", 3023103, "Potassium"),
    ("1742-6", 3006923, "ALT"),
    ("1920-8", 3013721, "AST"),
    ("1975-2", 3024128, "Bilirubin"),
    ("1751-7", 3024561, "Albumin"),
    ("5902-2", 3034426, "Prothrombin time"),
    ("6301-6", 3022217, "INR"),
]

# RxNorm code -> drug concept id, name
RXNORM_CONCEPTS = [
    ("860975", 19078461, "Metformin"),
    ("314076", 1308216, "Lisinopril"),
    ("617311", 1545958, "Atorvastatin"),
    ("329528", 1332418, "Amlodipine"),
    ("904453", 948078, "Omeprazole"),
    ("1191", 1112807, "Aspirin"),
    ("847230", 35894915, "Insulin glargine"),
    ("4603", 956874, "Furosemide"),
    ("11289", 1310149, "Warfarin"),
    ("42316", 950637, "Tacrolimus"),
    ("68149", 19003999, "Mycophenolate"),
    ("227718", 1304850, "Filgrastim"),
    ("26225", 1000560, "Ondansetron"),
    ("7052", 1110410, "Morphine"),
]

# short names usable in cohort criteria -> concept id
COHORT_ALIASES = [
    ("diabetes", 44054006), ("hypertension", 38341003), ("heart_failure", 84114007),
    ("ckd", 709044004), ("esrd", 46177005), ("leukemia", 93143009),
    ("breast_cancer", 254837009), ("lymphoma", 118601006),
    ("hemoglobin", 3000963), ("creatinine", 3016723), ("glucose", 3004501),
    ("hba1c", 3004410), ("wbc", 3010813), ("platelets", 3024929),
    ("metformin", 19078461), ("insulin", 35894915), ("lisinopril", 1308216),
    ("tacrolimus", 950637),
    ("inpatient", 9201), ("outpatient", 9202), ("emergency", 9203),
    ("male", 8507), ("female", 8532),
]

# condition concept id -> display name
CONDITION_NAMES = [
    (0, "Unmapped/Other"),
    (44054006, "Type 2 Diabetes"),
    (38341003, "Hypertension"),
    (84114007, "Heart Failure"),
    (709044004, "Chronic Kidney Disease"),
    (46177005, "End-Stage Renal Disease"),
    (93143009, "Acute Lymphoid Leukemia"),
    (254837009, "Breast Cancer"),
    (118601006, "Non-Hodgkin Lymphoma"),
    (109989006, "Multiple Myeloma"),
    (53741008, "Coronary Artery Disease"),
    (233604007, "Pneumonia"),
    (91302008, "Sepsis"),
    (14669001, "Acute Kidney Injury"),
    (230690007, "Stroke"),
    (22298006, "Myocardial Infarction"),
    (59282003, "Pulmonary Embolism"),
    (128053003, "Deep Vein Thrombosis"),
    (25370001, "Hepatocellular Carcinoma"),
    (363406005, "Colon Cancer"),
    (19943007, "Cirrhosis"),
    (417357006, "Sickle Cell Disease"),
    (40108008, "Thalassemia Major"),
]

# lower-cased institute name -> source system
SOURCE_SYSTEMS = [
    ("kfshrc", "HIS"),
    ("king faisal specialist hospital", "HIS"),
    ("riyadh military hospital", "EMR"),
    ("prince sultan military medical city", "EMR"),
    ("king fahd medical city", "LAB"),
    ("king abdulaziz medical city", "RAD"),
    ("king khalid university hospital", "ICU"),
]
DEFAULT_SOURCE_SYSTEM = "HIS"

# CSV header -> canonical column
COLUMN_ALIASES = [
    ("dob", "date_of_birth"), ("birth_date", "date_of_birth"), ("birthdate", "date_of_birth"),
    ("sex", "gender"), ("firstname", "first_name"), ("first", "first_name"),
    ("lastname", "last_name"), ("last", "last_name"),
    ("middlename", "middle_name"), ("middle", "middle_name"), ("familyname", "family_name"),
    ("phone", "phone_number"), ("telephone", "phone_number"),
    ("address", "address_line1"), ("street", "address_line1"),
    ("zipcode", "postal_code"), ("zip", "postal_code"), ("id", "patient_id"),
    ("national_id_number", "national_id"), ("nid", "national_id"),
    ("medical_record_number", "mrn"), ("diagnosis", "diagnosis_description"),
    ("icd_code", "diagnosis_code"), ("icd10", "diagnosis_code"), ("notes", "clinical_notes"),
    ("admit_date", "admission_date"), ("discharge", "discharge_date"), ("dept", "department"),
]
REQUIRED_COLUMNS = ["first_name", "last_name", "date_of_birth", "gender"]
OPTIONAL_COLUMNS = [
    "patient_id", "national_id", "mrn", "middle_name", "family_name", "phone_number", "email",
    "address_line1", "city", "region", "postal_code", "encounter_id", "encounter_type",
    "admission_date", "discharge_date", "department", "diagnosis_code", "diagnosis_description",
    "chief_complaint", "clinical_notes", "source_system",
]

# column order of the de-identified CSV
DEID_CSV_COLUMNS = [
    "patient_token", "surrogate_id", "gender", "year_of_birth", "month_of_birth",
    "age_at_data_collection", "region", "source_system", "encounter_id", "encounter_type",
    "admission_date", "discharge_date", "department", "chief_complaint", "admission_diagnosis",
    "clinical_notes",
]

# the identifier categories named in the de-identification report
SENSITIVE_IDENTIFIERS = [
    "names", "geographic_data", "dates", "phone_numbers", "fax_numbers", "email_addresses",
    "national_id_numbers", "medical_record_numbers", "health_insurance_numbers",
    "account_numbers", "certificate_license_numbers", "vehicle_identifiers",
    "device_identifiers", "web_urls", "ip_addresses", "biometric_identifiers",
    "full_face_photos", "any_other_unique_identifier",
]
DEID_METHOD = "PDPL-Compliant + HiPS"
