"""Note dictionary, entity classes and context cues.

FIXED VALUES: triggers, codes, confidences and cue phrases must equal the published dictionary (a
concept listed earlier wins a tie), so they are stated here as plain rows in their natural order.
"""

# entity class, label, layer, colour
ENTITY_CLASSES = [
    ("condition", "Condition / Disorder", "clinical", "#c0392b"),
    ("morphology", "Finding / Morphology", "clinical", "#d35400"),
    ("procedure", "Procedure", "clinical", "#27ae60"),
    ("medication", "Medication", "clinical", "#2980b9"),
    ("lab", "Lab / Assay", "clinical", "#8e44ad"),
    ("anatomical_site", "Anatomical Site", "clinical", "#16a085"),
    ("gene", "Gene", "molecular", "#b7950b"),
    ("variant", "Variant", "molecular", "#a04000"),
    ("biomarker", "Biomarker", "molecular", "#6c3483"),
]

# triggers, class, vocabulary, code, preferred term, semantic tag, confidence, note
CONCEPTS = [
    (['non-st elevation myocardial infarction', 'nstemi', 'non-stemi'], 'condition', 'SNOMED CT', '401303003', 'Acute non-ST segment elevation myocardial infarction', 'disorder', 0.96, ''),
    (['myocardial infarction', 'heart attack', 'stemi'], 'condition', 'SNOMED CT', '22298006', 'Myocardial infarction', 'disorder', 0.94, ''),
    (['acute coronary syndrome', 'acs'], 'condition', 'SNOMED CT', '394659003', 'Acute coronary syndrome', 'disorder', 0.92, ''),
    (['coronary artery disease', 'coronary artery disease (cad)', 'cad', 'ischemic heart disease'], 'condition', 'SNOMED CT', '53741008', 'Coronary arteriosclerosis', 'disorder', 0.91, ''),
    (['type 2 diabetes mellitus', 'type 2 diabetes', 't2dm', 'diabetes mellitus'], 'condition', 'SNOMED CT', '44054006', 'Type 2 diabetes mellitus', 'disorder', 0.95, ''),
    (['essential hypertension', 'hypertension', 'htn'], 'condition', 'SNOMED CT', '59621000', 'Essential hypertension', 'disorder', 0.93, ''),
    (['hyperlipidemia', 'dyslipidemia', 'hypercholesterolemia'], 'condition', 'SNOMED CT', '55822004', 'Hyperlipidemia', 'disorder', 0.9, ''),
    (['heart failure', 'congestive heart failure', 'chf'], 'condition', 'SNOMED CT', '84114007', 'Heart failure', 'disorder', 0.92, ''),
    (['acute kidney injury', 'aki', 'acute renal failure'], 'condition', 'SNOMED CT', '14669001', 'Acute kidney injury', 'disorder', 0.9, ''),
    (['acute respiratory failure', 'respiratory failure'], 'condition', 'SNOMED CT', '65710008', 'Acute respiratory failure', 'disorder', 0.89, ''),
    (['sepsis', 'septic shock'], 'condition', 'SNOMED CT', '91302008', 'Sepsis', 'disorder', 0.9, ''),
    (['community-acquired pneumonia', 'pneumonia'], 'condition', 'SNOMED CT', '233604007', 'Pneumonia', 'disorder', 0.9, ''),
    (['non-small cell lung cancer', 'non-small-cell lung carcinoma', 'nsclc'], 'condition', 'SNOMED CT', '254637007', 'Non-small cell lung cancer', 'disorder', 0.95, ''),
    (['adenocarcinoma of the lung', 'adenocarcinoma of lung', 'lung adenocarcinoma', 'pulmonary adenocarcinoma'], 'condition', 'SNOMED CT', '254626006', 'Adenocarcinoma of lung', 'disorder', 0.96, ''),
    (['malignant neoplasm', 'malignancy', 'malignant tumor'], 'condition', 'SNOMED CT', '363346000', 'Malignant neoplastic disease', 'disorder', 0.86, ''),
    (['adenocarcinoma'], 'morphology', 'SNOMED CT', '35917007', 'Adenocarcinoma', 'morphologic abnormality', 0.9, ''),
    (['poorly differentiated', 'poor differentiation'], 'morphology', 'SNOMED CT', '63283001', 'Poorly differentiated', 'qualifier value', 0.82, ''),
    (['lymphovascular invasion'], 'morphology', 'SNOMED CT', '371512006', 'Presence of lymphovascular invasion', 'finding', 0.84, ''),
    (['st-segment depression', 'st segment depression', 'st depression'], 'morphology', 'SNOMED CT', '164931005', 'ST segment depression', 'finding', 0.85, ''),
    (['hypokinesis', 'wall hypokinesis', 'anterior hypokinesis'], 'morphology', 'SNOMED CT', '53533004', 'Hypokinesia of cardiac wall', 'finding', 0.8, ''),
    (['pulmonary congestion', 'vascular congestion'], 'morphology', 'SNOMED CT', '196911008', 'Pulmonary congestion', 'finding', 0.82, ''),
    (['chest pain'], 'morphology', 'SNOMED CT', '29857009', 'Chest pain', 'finding', 0.88, ''),
    (['shortness of breath', 'dyspnea', 'breathlessness'], 'morphology', 'SNOMED CT', '267036007', 'Dyspnea', 'finding', 0.88, ''),
    (['percutaneous coronary intervention', 'pci'], 'procedure', 'SNOMED CT', '415070008', 'Percutaneous coronary intervention', 'procedure', 0.93, ''),
    (['cardiac catheterization', 'coronary angiography', 'cardiac cath'], 'procedure', 'SNOMED CT', '41976001', 'Cardiac catheterization', 'procedure', 0.91, ''),
    (['echocardiogram', 'echocardiography', 'transthoracic echocardiogram', 'tte'], 'procedure', 'SNOMED CT', '40701008', 'Echocardiography', 'procedure', 0.91, ''),
    (['electrocardiogram', 'ecg', 'ekg', '12-lead ecg'], 'procedure', 'SNOMED CT', '29303009', 'Electrocardiographic procedure', 'procedure', 0.92, ''),
    (['mechanical ventilation', 'mechanical ventilatory support'], 'procedure', 'SNOMED CT', '40617009', 'Artificial respiration', 'procedure', 0.86, ''),
    (['drug-eluting stent', 'coronary stent placement', 'stent placement'], 'procedure', 'SNOMED CT', '36969009', 'Placement of stent in coronary artery', 'procedure', 0.85, ''),
    (['ct-guided core needle biopsy', 'core needle biopsy', 'needle biopsy', 'transthoracic biopsy'], 'procedure', 'SNOMED CT', '67800003', 'Core needle biopsy', 'procedure', 0.88, ''),
    (['biopsy of lung', 'lung biopsy'], 'procedure', 'SNOMED CT', '173978000', 'Biopsy of lung', 'procedure', 0.87, ''),
    (['immunohistochemistry', 'ihc'], 'procedure', 'SNOMED CT', '250564007', 'Immunohistochemistry technique', 'procedure', 0.84, ''),
    (['next-generation sequencing', 'ngs', 'next generation sequencing'], 'procedure', 'SNOMED CT', '117040002', 'Nucleic acid sequencing', 'procedure', 0.82, ''),
    (['left upper lobe of the lung', 'left upper lobe', 'lul'], 'anatomical_site', 'SNOMED CT', '45653009', 'Structure of left upper lobe of lung', 'body structure', 0.9, ''),
    (['lung parenchyma', 'lung'], 'anatomical_site', 'SNOMED CT', '39607008', 'Lung structure', 'body structure', 0.85, ''),
    (['pleura', 'pleural surface'], 'anatomical_site', 'SNOMED CT', '3120008', 'Pleural structure', 'body structure', 0.82, ''),
    (['mediastinal lymph node', 'mediastinal lymph nodes'], 'anatomical_site', 'SNOMED CT', '127157005', 'Mediastinal lymph node structure', 'body structure', 0.83, ''),
    (['left anterior descending', 'lad coronary artery', 'lad artery'], 'anatomical_site', 'SNOMED CT', '59820001', 'Structure of left anterior descending coronary artery', 'body structure', 0.84, ''),
    (['aspirin'], 'medication', 'RxNorm', '1191', 'Aspirin', 'substance', 0.92, ''),
    (['clopidogrel', 'plavix'], 'medication', 'RxNorm', '32968', 'Clopidogrel', 'substance', 0.92, ''),
    (['atorvastatin', 'lipitor'], 'medication', 'RxNorm', '83367', 'Atorvastatin', 'substance', 0.92, ''),
    (['metoprolol', 'toprol'], 'medication', 'RxNorm', '6918', 'Metoprolol', 'substance', 0.9, ''),
    (['lisinopril'], 'medication', 'RxNorm', '29046', 'Lisinopril', 'substance', 0.9, ''),
    (['metformin'], 'medication', 'RxNorm', '6809', 'Metformin', 'substance', 0.9, ''),
    (['heparin'], 'medication', 'RxNorm', '5224', 'Heparin', 'substance', 0.88, ''),
    (['nitroglycerin'], 'medication', 'RxNorm', '4917', 'Nitroglycerin', 'substance', 0.87, ''),
    (['osimertinib', 'tagrisso'], 'medication', 'RxNorm', '1721560', 'Osimertinib', 'substance', 0.9, ''),
    (['pembrolizumab', 'keytruda'], 'medication', 'RxNorm', '1547545', 'Pembrolizumab', 'substance', 0.9, ''),
    (['troponin i', 'troponin', 'hs-troponin'], 'lab', 'LOINC', '10839-9', 'Troponin I, cardiac [Mass/volume]', 'lab', 0.9, ''),
    (['hba1c', 'hemoglobin a1c', 'glycated hemoglobin'], 'lab', 'LOINC', '4548-4', 'Hemoglobin A1c/Hemoglobin.total', 'lab', 0.9, ''),
    (['bnp', 'b-type natriuretic peptide'], 'lab', 'LOINC', '30934-4', 'Natriuretic peptide B [Mass/volume]', 'lab', 0.86, ''),
    (['ldl cholesterol', 'ldl'], 'lab', 'LOINC', '13457-7', 'LDL cholesterol (calculated)', 'lab', 0.86, ''),
    (['creatinine'], 'lab', 'LOINC', '2160-0', 'Creatinine [Mass/volume] in Serum or Plasma', 'lab', 0.88, ''),
    (['egfr mutation analysis', 'egfr mutation testing', 'egfr gene mutation analysis'], 'lab', 'LOINC', '21665-5', 'EGFR gene mutations found [Identifier]', 'lab', 0.9, ''),
    (['pd-l1 immunohistochemistry', 'pd-l1 ihc', 'pd-l1 assay'], 'lab', 'LOINC', '83346-9', 'PD-L1 [Presence] by Immune stain', 'lab', 0.86, ''),
    (['egfr', 'epidermal growth factor receptor'], 'gene', 'HGNC', 'HGNC:3236', 'EGFR', 'gene', 0.95, 'Epidermal growth factor receptor; chr 7p11.2'),
    (['alk'], 'gene', 'HGNC', 'HGNC:427', 'ALK', 'gene', 0.9, 'ALK receptor tyrosine kinase; chr 2p23.2'),
    (['kras'], 'gene', 'HGNC', 'HGNC:6407', 'KRAS', 'gene', 0.9, 'KRAS proto-oncogene; chr 12p12.1'),
    (['ros1'], 'gene', 'HGNC', 'HGNC:10261', 'ROS1', 'gene', 0.88, 'ROS proto-oncogene 1; chr 6q22.1'),
    (['pd-l1', 'cd274', 'programmed death-ligand 1'], 'gene', 'HGNC', 'HGNC:17635', 'CD274', 'gene', 0.88, 'CD274 / PD-L1; chr 9p24.1'),
    (['braf'], 'gene', 'HGNC', 'HGNC:1097', 'BRAF', 'gene', 0.88, 'B-Raf proto-oncogene; chr 7q34'),
    (['exon 19 deletion', 'exon 19 in-frame deletion', 'ex19del', 'e746_a750del', 'p.glu746_ala750del'], 'variant', 'HGVS', 'p.Glu746_Ala750del', 'EGFR exon 19 in-frame deletion (c.2235_2249del)', 'variant', 0.92, 'ClinVar: Pathogenic; EGFR-TKI sensitizing'),
    (['l858r', 'p.leu858arg', 'exon 21 l858r'], 'variant', 'HGVS', 'p.Leu858Arg', 'EGFR p.Leu858Arg (c.2573T>G)', 'variant', 0.9, 'ClinVar: Pathogenic; EGFR-TKI sensitizing'),
    (['t790m', 'p.thr790met'], 'variant', 'HGVS', 'p.Thr790Met', 'EGFR p.Thr790Met (c.2369C>T)', 'variant', 0.9, 'ClinVar: Pathogenic; EGFR-TKI resistance'),
    (['g12c', 'p.gly12cys', 'kras g12c'], 'variant', 'HGVS', 'p.Gly12Cys', 'KRAS p.Gly12Cys (c.34G>T)', 'variant', 0.9, 'ClinVar: Pathogenic; KRAS G12C-inhibitor target'),
    (['pd-l1 tps', 'tumor proportion score', 'pd-l1 expression'], 'biomarker', 'LOINC', '83346-9', 'PD-L1 tumor proportion score', 'biomarker', 0.85, 'Reported as Tumor Proportion Score (TPS)'),
    (['egfr gene mutation positive', 'egfr-mutant', 'egfr mutated', 'egfr positive'], 'biomarker', 'SNOMED CT', '405923000', 'Epidermal growth factor receptor gene mutation positive', 'finding', 0.85, 'Illustrative SNOMED finding for the EGFR-positive result'),
]

# cues looked up in the text just before an entity
NEGATION_BEFORE = [
    "no evidence of", "no evidence", "negative for", "no ", "without",
    "denies", "denied", "absence of", "absent", "ruled out", "rule out",
    "not detected", "not identified", "no significant", "free of", "unremarkable for",
]
# cues looked up in the text just after an entity
NEGATION_AFTER = [
    "negative", "not detected", "not identified", "not required", "no mutation",
    "no rearrangement", "no fusion", "no evidence", "absent", "wild-type", "wild type",
]
HISTORY_CUES = [
    "history of", "h/o", "hx of", "past medical history", "pmh", "previously",
    "previous", "prior", "status post", "s/p", "in 20", "years ago", "year ago",
    "diagnosed in", "diagnosed 20", "old ", "remote", "resolved",
]
FAMILY_CUES = [
    "family history", "fh:", "father", "mother", "brother", "sister", "sibling",
    "parent", "maternal", "paternal", "grandfather", "grandmother", "son", "daughter",
]
CHARS_BEFORE = 45
CHARS_AFTER = 30

SENTENCE_END = r"[.!?]+(?=\s|$)|\n\s*\n"
SECTION_HEADER = r"^\s*([A-Z][A-Z /&-]{3,}):"

ENTITY_CSV_COLUMNS = [
    "span_text", "entity_type", "layer", "vocabulary", "concept", "code", "confidence",
    "negated", "historical", "subject", "context",
]
