"""Vocabulary entries.

FIXED VALUES: codes, terms, synonyms, units and ranges below must equal the published curated
subsets entry for entry and in this order (the first match in order wins), so they are stated here
as plain rows.
"""

SNOMED_VERSION = "2024-01"
# (code, term, synonyms, semantic_type)
SNOMED = [
    ('22298006', 'Myocardial infarction', ['Heart attack', 'MI', 'Acute MI', 'STEMI', 'NSTEMI'], 'disorder'),
    ('394659003', 'Acute coronary syndrome', ['ACS', 'Unstable angina', 'Acute coronary event'], 'disorder'),
    ('44054006', 'Type 2 diabetes mellitus', ['T2DM', 'Type 2 diabetes', 'Diabetes mellitus type 2', 'Adult-onset diabetes', 'NIDDM'], 'disorder'),
    ('38341003', 'Hypertensive disorder', ['Hypertension', 'High blood pressure', 'HTN', 'Essential hypertension'], 'disorder'),
    ('84114007', 'Heart failure', ['CHF', 'Congestive heart failure', 'Cardiac failure', 'HF'], 'disorder'),
    ('49436004', 'Atrial fibrillation', ['AFib', 'A-fib', 'AF', 'Auricular fibrillation'], 'disorder'),
    ('13645005', 'Chronic obstructive pulmonary disease', ['COPD', 'Chronic obstructive lung disease', 'COLD'], 'disorder'),
    ('195967001', 'Asthma', ['Bronchial asthma', 'Reactive airway disease'], 'disorder'),
    ('709044004', 'Chronic kidney disease', ['CKD', 'Chronic renal disease', 'Chronic renal failure'], 'disorder'),
    ('46177005', 'End-stage renal disease', ['ESRD', 'End-stage kidney disease', 'Kidney failure'], 'disorder'),
    ('254837009', 'Malignant neoplasm of breast', ['Breast cancer', 'Breast carcinoma', 'Mammary cancer'], 'disorder'),
    ('93143009', 'Acute lymphoid leukemia', ['ALL', 'Acute lymphoblastic leukemia', 'Lymphoblastic leukemia'], 'disorder'),
    ('233604007', 'Pneumonia', ['Lung infection', 'Pulmonary infection', 'Community-acquired pneumonia', 'CAP'], 'disorder'),
    ('91302008', 'Sepsis', ['Septicemia', 'Blood poisoning', 'Systemic infection'], 'disorder'),
    ('230690007', 'Cerebrovascular accident', ['Stroke', 'CVA', 'Brain attack', 'Cerebral infarction'], 'disorder'),
    ('59282003', 'Pulmonary embolism', ['PE', 'Lung clot', 'Pulmonary thromboembolism'], 'disorder'),
    ('128053003', 'Deep vein thrombosis', ['DVT', 'Deep venous thrombosis', 'Leg clot'], 'disorder'),
    ('267036007', 'Dyspnea', ['Shortness of breath', 'SOB', 'Breathlessness', 'Difficulty breathing'], 'finding'),
    ('29857009', 'Chest pain', ['Thoracic pain', 'Chest discomfort', 'Angina'], 'finding'),
    ('386661006', 'Fever', ['Pyrexia', 'Elevated temperature', 'Febrile'], 'finding'),
    ('25064002', 'Headache', ['Cephalgia', 'Head pain'], 'finding'),
    ('422587007', 'Nausea', ['Feeling sick', 'Queasy'], 'finding'),
    ('422400008', 'Vomiting', ['Emesis', 'Throwing up'], 'finding'),
    ('62315008', 'Diarrhea', ['Loose stool', 'Watery stool'], 'finding'),
    ('21522001', 'Abdominal pain', ['Stomach pain', 'Belly pain', 'Abdominal discomfort'], 'finding'),
    ('271807003', 'Rash', ['Skin eruption', 'Exanthem'], 'finding'),
    ('182531007', 'Smoking history', ['Tobacco use', 'Smoker', 'Cigarette use'], 'finding'),
    ('228273003', 'Alcohol consumption', ['Alcohol use', 'Drinking', 'Ethanol use'], 'finding'),
]

ICD10_VERSION = "2024"
# (code, description, long_description, category, snomed_mapping)
ICD10 = [
    ('I21.9', 'Acute myocardial infarction, unspecified', 'Acute myocardial infarction, unspecified site', 'Ischemic heart diseases', '22298006'),
    ('I21.0', 'ST elevation myocardial infarction of anterior wall', 'ST elevation (STEMI) myocardial infarction involving left anterior descending coronary artery', 'Ischemic heart diseases', '22298006'),
    ('I21.4', 'Non-ST elevation myocardial infarction', 'Non-ST elevation (NSTEMI) myocardial infarction', 'Ischemic heart diseases', '22298006'),
    ('I24.9', 'Acute ischemic heart disease, unspecified', 'Acute coronary syndrome, unspecified', 'Ischemic heart diseases', '394659003'),
    ('E11.9', 'Type 2 diabetes mellitus without complications', 'Type 2 diabetes mellitus without complications', 'Diabetes mellitus', '44054006'),
    ('E11.65', 'Type 2 diabetes with hyperglycemia', 'Type 2 diabetes mellitus with hyperglycemia', 'Diabetes mellitus', '44054006'),
    ('I10', 'Essential hypertension', 'Essential (primary) hypertension', 'Hypertensive diseases', '38341003'),
    ('I50.9', 'Heart failure, unspecified', 'Heart failure, unspecified', 'Heart failure', '84114007'),
    ('I48.91', 'Atrial fibrillation, unspecified', 'Unspecified atrial fibrillation', 'Cardiac arrhythmias', '49436004'),
    ('J44.9', 'Chronic obstructive pulmonary disease, unspecified', 'Chronic obstructive pulmonary disease, unspecified', 'Chronic lower respiratory diseases', '13645005'),
    ('J45.909', 'Asthma, unspecified', 'Unspecified asthma, uncomplicated', 'Chronic lower respiratory diseases', '195967001'),
    ('N18.9', 'Chronic kidney disease, unspecified', 'Chronic kidney disease, unspecified stage', 'Renal tubulo-interstitial diseases', '709044004'),
    ('N18.6', 'End stage renal disease', 'End stage renal disease', 'Renal tubulo-interstitial diseases', '46177005'),
    ('C50.919', 'Malignant neoplasm of breast', 'Malignant neoplasm of unspecified site of unspecified female breast', 'Malignant neoplasms of breast', '254837009'),
    ('C91.00', 'Acute lymphoblastic leukemia', 'Acute lymphoblastic leukemia not having achieved remission', 'Malignant neoplasms of lymphoid tissue', '93143009'),
    ('J18.9', 'Pneumonia, unspecified organism', 'Pneumonia, unspecified organism', 'Pneumonia', '233604007'),
    ('A41.9', 'Sepsis, unspecified organism', 'Sepsis, unspecified organism', 'Other sepsis', '91302008'),
    ('I63.9', 'Cerebral infarction, unspecified', 'Cerebral infarction, unspecified', 'Cerebrovascular diseases', '230690007'),
    ('I26.99', 'Other pulmonary embolism', 'Other pulmonary embolism without acute cor pulmonale', 'Pulmonary heart disease', '59282003'),
    ('I82.40', 'Deep vein thrombosis of lower extremity', 'Acute embolism and thrombosis of unspecified deep veins of lower extremity', 'Venous embolism and thrombosis', '128053003'),
    ('R06.02', 'Shortness of breath', 'Shortness of breath', 'Symptoms and signs involving the respiratory system', '267036007'),
    ('R07.9', 'Chest pain, unspecified', 'Chest pain, unspecified', 'Symptoms and signs involving the circulatory system', '29857009'),
    ('R50.9', 'Fever, unspecified', 'Fever, unspecified', 'General symptoms and signs', '386661006'),
    ('Z87.891', 'Personal history of nicotine dependence', 'Personal history of nicotine dependence', 'Personal history', '182531007'),
]

LOINC_VERSION = "2.76"
# (code, component, short_name, unit, range_low, range_high)
LOINC = [
    ('49563-0', 'Troponin I.cardiac', 'Troponin I cardiac', 'ng/mL', 0.0, 0.04),
    ('10839-9', 'Troponin I.cardiac', 'hs-Troponin I', 'ng/L', 0.0, 14.0),
    ('4548-4', 'Hemoglobin A1c/Hemoglobin.total', 'HbA1c', '%', 4.0, 5.6),
    ('2085-9', 'Cholesterol in HDL', 'HDL Cholesterol', 'mg/dL', 40.0, 60.0),
    ('2089-1', 'Cholesterol in LDL', 'LDL Cholesterol', 'mg/dL', 0.0, 100.0),
    ('2093-3', 'Cholesterol', 'Total Cholesterol', 'mg/dL', 0.0, 200.0),
    ('2571-8', 'Triglyceride', 'Triglycerides', 'mg/dL', 0.0, 150.0),
    ('2160-0', 'Creatinine', 'Creatinine', 'mg/dL', 0.7, 1.3),
    ('3094-0', 'Urea nitrogen', 'BUN', 'mg/dL', 7.0, 20.0),
    ('33914-3', 'Glomerular filtration rate/1.73 sq M.predicted', 'eGFR', 'mL/min/1.73m2', 90.0, 120.0),
    ('2345-7', 'Glucose', 'Glucose', 'mg/dL', 70.0, 100.0),
    ('718-7', 'Hemoglobin', 'Hemoglobin', 'g/dL', 12.0, 17.5),
    ('4544-3', 'Hematocrit', 'Hematocrit', '%', 36.0, 50.0),
    ('6690-2', 'Leukocytes', 'WBC', '10^3/uL', 4.5, 11.0),
    ('777-3', 'Platelets', 'Platelets', '10^3/uL', 150.0, 400.0),
    ('2951-2', 'Sodium', 'Sodium', 'mEq/L', 136.0, 145.0),
    ('2823-3', 'Potassium', 'Potassium', 'mEq/L', 3.5, 5.0),
    ('2075-0', 'Chloride', 'Chloride', 'mEq/L', 98.0, 106.0),
    ('1920-8', 'Aspartate aminotransferase', 'AST', 'U/L', 10.0, 40.0),
    ('1742-6', 'Alanine aminotransferase', 'ALT', 'U/L', 7.0, 56.0),
    ('8480-6', 'Systolic blood pressure', 'SBP', 'mm[Hg]', 90.0, 120.0),
    ('8462-4', 'Diastolic blood pressure', 'DBP', 'mm[Hg]', 60.0, 80.0),
    ('8867-4', 'Heart rate', 'Heart Rate', '/min', 60.0, 100.0),
    ('8310-5', 'Body temperature', 'Temperature', 'Cel', 36.1, 37.2),
    ('9279-1', 'Respiratory rate', 'Resp Rate', '/min', 12.0, 20.0),
    ('2708-6', 'Oxygen saturation', 'SpO2', '%', 95.0, 100.0),
]

RXNORM_VERSION = "2024-01"
# (code, name, generic_name, brand_names, drug_class, common_doses)
RXNORM = [
    ('860975', 'Metformin', 'metformin hydrochloride', ['Glucophage', 'Fortamet', 'Glumetza'], 'Biguanides', ['500mg', '850mg', '1000mg']),
    ('314076', 'Lisinopril', 'lisinopril', ['Prinivil', 'Zestril'], 'ACE inhibitors', ['2.5mg', '5mg', '10mg', '20mg', '40mg']),
    ('617311', 'Atorvastatin', 'atorvastatin calcium', ['Lipitor'], 'HMG-CoA reductase inhibitors (Statins)', ['10mg', '20mg', '40mg', '80mg']),
    ('1191', 'Aspirin', 'aspirin', ['Bayer', 'Ecotrin', 'Bufferin'], 'Salicylates / Antiplatelet agents', ['81mg', '325mg']),
    ('329528', 'Amlodipine', 'amlodipine besylate', ['Norvasc'], 'Calcium channel blockers (Dihydropyridines)', ['2.5mg', '5mg', '10mg']),
    ('200031', 'Carvedilol', 'carvedilol', ['Coreg'], 'Beta-blockers (non-selective with alpha-blocking)', ['3.125mg', '6.25mg', '12.5mg', '25mg']),
    ('4603', 'Furosemide', 'furosemide', ['Lasix'], 'Loop diuretics', ['20mg', '40mg', '80mg']),
    ('11289', 'Warfarin', 'warfarin sodium', ['Coumadin', 'Jantoven'], 'Vitamin K antagonists', ['1mg', '2mg', '2.5mg', '3mg', '4mg', '5mg', '7.5mg', '10mg']),
    ('1364430', 'Apixaban', 'apixaban', ['Eliquis'], 'Direct oral anticoagulants (Factor Xa inhibitors)', ['2.5mg', '5mg']),
    ('1037045', 'Clopidogrel', 'clopidogrel bisulfate', ['Plavix'], 'P2Y12 inhibitors (Antiplatelet agents)', ['75mg', '300mg (loading)']),
    ('213169', 'Heparin', 'heparin sodium', ['Hep-Lock'], 'Anticoagulants (Unfractionated heparins)', ['5000 units', 'Weight-based infusion']),
    ('7052', 'Morphine', 'morphine sulfate', ['MS Contin', 'Roxanol'], 'Opioid analgesics', ['2mg', '4mg', '10mg', '15mg']),
    ('904453', 'Omeprazole', 'omeprazole', ['Prilosec'], 'Proton pump inhibitors', ['20mg', '40mg']),
    ('7646', 'Nitroglycerin', 'nitroglycerin', ['Nitrostat', 'Nitro-Bid', 'Nitro-Dur'], 'Nitrates', ['0.4mg SL', '5-200 mcg/min IV']),
    ('8896', 'Oxygen', 'oxygen', [], 'Medical gases', ['2-6 L/min nasal cannula', '10-15 L/min non-rebreather']),
    ('847230', 'Insulin glargine', 'insulin glargine', ['Lantus', 'Basaglar', 'Toujeo'], 'Long-acting insulins', ['Patient-specific dosing']),
    ('1798509', 'Insulin lispro', 'insulin lispro', ['Humalog', 'Admelog'], 'Rapid-acting insulins', ['Patient-specific dosing']),
    ('26225', 'Ondansetron', 'ondansetron', ['Zofran'], '5-HT3 receptor antagonists', ['4mg', '8mg']),
    ('42316', 'Tacrolimus', 'tacrolimus', ['Prograf', 'Envarsus'], 'Calcineurin inhibitors', ['0.5mg', '1mg', '5mg']),
    ('68149', 'Mycophenolate mofetil', 'mycophenolate mofetil', ['CellCept'], 'Immunosuppressants (IMPDH inhibitors)', ['250mg', '500mg', '1000mg']),
]

CPT_VERSION = "2024"
# (code, short_description, long_description, category)
CPT = [
    ('93000', 'Electrocardiogram, routine', 'Electrocardiogram, routine ECG with at least 12 leads; with interpretation and report', 'Cardiovascular'),
    ('93010', 'Electrocardiogram, interpretation', 'Electrocardiogram, routine ECG with at least 12 leads; interpretation and report only', 'Cardiovascular'),
    ('93306', 'Echocardiography, TTE with Doppler', 'Echocardiography, transthoracic, real-time with image documentation (2D), includes M-mode recording, with spectral Doppler, complete', 'Cardiovascular'),
    ('93458', 'Left heart catheterization', 'Catheter placement in coronary artery(s) for coronary angiography, including intraprocedural injection(s) for coronary angiography, imaging supervision and interpretation; with left heart catheterization', 'Cardiovascular'),
    ('93510', 'Left heart catheterization, retrograde', 'Left heart catheterization, retrograde, from the brachial artery, axillary artery or femoral artery; percutaneous', 'Cardiovascular'),
    ('92928', 'PCI with stent, single vessel', 'Percutaneous transcatheter placement of intracoronary stent(s), with coronary angioplasty when performed; single major coronary artery or branch', 'Cardiovascular'),
    ('71046', 'Chest X-ray, 2 views', 'Radiologic examination, chest; 2 views, frontal and lateral', 'Radiology'),
    ('71250', 'CT chest without contrast', 'Computed tomography, thorax; without contrast material', 'Radiology'),
    ('71260', 'CT chest with contrast', 'Computed tomography, thorax; with contrast material(s)', 'Radiology'),
    ('71275', 'CT angiography, chest', 'Computed tomographic angiography, chest (noncoronary), with contrast material(s), including noncontrast images, if performed, and image postprocessing', 'Radiology'),
    ('74176', 'CT abdomen and pelvis without contrast', 'Computed tomography, abdomen and pelvis; without contrast material', 'Radiology'),
    ('70553', 'MRI brain with and without contrast', 'Magnetic resonance imaging, brain (including brain stem); without contrast material, followed by contrast material(s) and further sequences', 'Radiology'),
    ('36556', 'Central venous catheter insertion', 'Insertion of non-tunneled centrally inserted central venous catheter; age 5 years or older', 'Vascular'),
    ('36620', 'Arterial line placement', 'Arterial catheterization or cannulation for sampling, monitoring or transfusion; percutaneous', 'Vascular'),
    ('31500', 'Intubation, endotracheal', 'Intubation, endotracheal, emergency procedure', 'Respiratory'),
    ('94003', 'Ventilator management, first day', 'Ventilator management; first day', 'Respiratory'),
    ('99291', 'Critical care, first 30-74 minutes', 'Critical care, evaluation and management of the critically ill or critically injured patient; first 30-74 minutes', 'Evaluation and Management'),
    ('99223', 'Initial hospital care, high severity', 'Initial hospital care, per day, for the evaluation and management of a patient, which requires a medically appropriate history and/or examination and high level of medical decision making', 'Evaluation and Management'),
    ('99232', 'Subsequent hospital care, moderate', 'Subsequent hospital care, per day, for the evaluation and management of a patient, which requires a medically appropriate history and/or examination and moderate level of medical decision making', 'Evaluation and Management'),
    ('99238', 'Hospital discharge day, 30 min or less', 'Hospital discharge day management; 30 minutes or less', 'Evaluation and Management'),
    ('85025', 'Complete blood count (CBC)', 'Blood count; complete (CBC), automated (Hgb, Hct, RBC, WBC and platelet count) and automated differential WBC count', 'Pathology and Laboratory'),
    ('80053', 'Comprehensive metabolic panel', 'Comprehensive metabolic panel (Albumin, bilirubin, calcium, carbon dioxide, chloride, creatinine, glucose, phosphatase alkaline, potassium, protein total, sodium, urea nitrogen, AST, ALT)', 'Pathology and Laboratory'),
    ('80048', 'Basic metabolic panel', 'Basic metabolic panel (Calcium, carbon dioxide, chloride, creatinine, glucose, potassium, sodium, urea nitrogen)', 'Pathology and Laboratory'),
    ('84484', 'Troponin, quantitative', 'Troponin, quantitative', 'Pathology and Laboratory'),
    ('83036', 'Hemoglobin A1c', 'Hemoglobin; glycosylated (A1C)', 'Pathology and Laboratory'),
]
