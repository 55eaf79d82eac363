"""Fixed values of the standard fields: their names, the analyses that need them, and words that samples are told by."""

#: Standard fields and the names they are shown under.
FIELD_NAMES = {
    "business_unit": "Business Unit", "contract_end_date": "Contract End Date", "contract_id": "Contract ID", "contract_indicator": "Contract indicator",
    "contract_start_date": "Contract Start Date", "contract_status": "Contract Status", "description": "Description", "goods_receipt_date": "Goods Receipt Date",
    "invoice_date": "Invoice Date", "invoice_due_date": "Invoice Due Date", "invoice_number": "Invoice Number", "invoice_po_number": "Invoice PO Number",
    "payment_date": "Payment Date", "payment_terms": "Payment Terms", "plant_code": "Plant Code", "country": "Plant Country", "plant_name": "Plant Name",
    "po_document_date": "PO Document Date", "po_material_number": "PO Material Number", "po_material_description": "PO Material Description",
    "price_per_uom": "Price per UOM", "quantity": "Quantity", "region": "Region", "l1": "Spend Classification Level 1", "l2": "Spend Classification Level 2",
    "l3": "Spend Classification Level 3", "l4": "Spend Classification Level 4", "local_spend": "Total Amount paid in Local Currency",
    "currency": "Local Currency Code", "total_spend": "Total Amount paid in Reporting Currency", "uom": "Unit of Measurement",
    "vendor_country": "Vendor Country", "supplier": "Vendor Name",
}

#: Other spellings of the standard fields, besides the names they are shown under.
FIELD_ALIASES = {
    "business_unit": ["BU", "Division", "Business Area"], "contract_end_date": ["Contract Expiry Date", "Contract Expiration"],
    "contract_id": ["Contract Number", "Contract Ref", "Agreement ID"], "contract_indicator": ["Contract Flag", "Has Contract", "Contract Y/N"],
    "contract_start_date": ["Contract Effective Date", "Contract Begin Date"], "contract_status": ["Contract State", "Agreement Status"],
    "description": ["Invoice Description", "Material Description", "GL Account Description", "Item Description", "Line Description", "PO Material Description", "Product Description", "Service Description"],
    "goods_receipt_date": ["GR Date", "Delivery Date", "Receipt Date"], "invoice_date": ["Inv Date", "Billing Date", "Transaction Date"], "invoice_due_date": ["Due Date", "Payment Due Date", "Inv Due Date"],
    "invoice_number": ["Invoice No", "Invoice #", "Invoice ID", "Inv Number"], "invoice_po_number": ["PO Number", "PO #", "Purchase Order Number", "PO Ref"],
    "payment_date": ["Pay Date", "Date Paid", "Clearing Date"], "payment_terms": ["Pay Terms", "Terms of Payment", "Payment Condition"],
    "plant_code": ["Plant ID", "Plant No", "Facility Code", "Site Code"], "country": ["Country", "Company Country", "Plant Country"], "plant_name": ["Plant Description", "Facility Name", "Site Name"],
    "po_document_date": ["PO Date", "Order Date", "Purchase Order Date"], "po_material_number": ["Material Number", "Material Code", "Item Number", "Material ID"],
    "po_material_description": ["PO Description", "Purchase Order Description", "PO Line Description", "PO Text"], "price_per_uom": ["Unit Price", "Price per Unit", "PO Unit Price"],
    "quantity": ["Invoice Line Number Quantity", "Invoice Quantity", "Line Qty", "Billed Quantity", "Order Quantity", "Qty"], "region": ["Geographic Region", "Sales Region", "Market Region"],
    "l1": ["Category Level 1", "L1", "Category 1", "Segment"], "l2": ["Category Level 2", "L2", "Category 2", "Family", "Sub-category"], "l3": ["Category Level 3", "L3", "Category 3", "Class", "Commodity"],
    "l4": ["Category Level 4", "L4", "Category 4", "Sub-class"], "local_spend": ["Local Spend Amount", "Local Spend", "Invoice Amount"],
    "currency": ["Currency", "Invoice Currency", "Currency Code", "Local Currency"], "total_spend": ["Total Spend (USD)", "Total Spend", "Reporting Currency Amount"],
    "uom": ["Invoice Line Number Quantity UOM", "UOM", "Invoice UOM", "Line UOM", "Quantity Unit", "Unit of Measure"], "vendor_country": ["Supplier Country", "Vendor Nation"], "supplier": ["Supplier Name", "Supplier", "Vendor"],
}

#: Abbreviations in headers and what they stand for.
ABBREVIATIONS = {
    "amt": "amount", "amts": "amounts", "dt": "date", "dte": "date", "dts": "dates", "no": "number", "num": "number", "nm": "name", "nme": "name", "desc": "description", "descr": "description",
    "cd": "code", "ctr": "center", "ctry": "country", "ccy": "currency", "curr": "currency", "vend": "vendor", "supp": "supplier", "inv": "invoice", "purch": "purchase", "mat": "material", "matl": "material",
    "grp": "group", "qty": "quantity", "uom": "unit of measure", "gr": "goods receipt", "gl": "gl account", "po": "purchase order", "cc": "cost center", "bu": "business unit", "fy": "fiscal year",
    "rc": "reporting currency", "lc": "local currency", "pc": "profit center", "ref": "reference", "pay": "payment", "bal": "balance", "fx": "currency", "exch": "exchange",
}

#: Dashboards: title and the fields each needs.
DASHBOARDS = {
    "contract_status": ("Contract Status", ["contract_end_date", "contract_id", "contract_start_date", "local_spend", "supplier", "total_spend"]),
    "dynamic_spend_view": ("Dynamic Spend View", ["business_unit", "contract_end_date", "contract_indicator", "contract_start_date", "invoice_po_number", "plant_code", "plant_name", "local_spend", "supplier", "contract_status", "total_spend"]),
    "fy_spend_overview": ("FY20 Spend Overview", ["business_unit", "plant_code", "plant_name", "local_spend", "supplier", "total_spend"]),
    "lcc_sourcing": ("Low Cost Country (LCC) Sourcing", ["local_spend", "vendor_country", "supplier", "total_spend"]),
    "material_deep_dive": ("Material wise deep dive", ["quantity", "uom", "description", "po_material_number", "local_spend", "supplier", "total_spend"]),
    "maverick_spend": ("Maverick Spend", ["goods_receipt_date", "invoice_po_number", "po_document_date", "local_spend", "total_spend"]),
    "mega_supplier_sourcing": ("Mega Supplier Sourcing", ["local_spend", "supplier", "total_spend"]),
    "payment_terms_rationalization": ("Payment terms rationalization", ["payment_terms", "local_spend", "supplier", "total_spend"]),
    "peer_benchmarking": ("Peer to peer/ Industry benchmarking analysis", ["local_spend", "total_spend"]),
    "price_rationalization": ("Price Rationalization", ["contract_indicator", "invoice_date", "quantity", "plant_code", "plant_name", "description", "po_material_number", "local_spend", "supplier", "total_spend"]),
    "savings_potential_price": ("Savings Potential - Price rationalization", ["quantity", "uom", "plant_code", "plant_name", "description", "po_material_number", "price_per_uom", "local_spend", "total_spend"]),
    "size_of_prize": ("Size of prize", ["local_spend", "total_spend"]),
    "specification_rationalization": ("Specification rationalization", ["contract_indicator", "quantity", "description", "po_material_number", "price_per_uom", "local_spend", "total_spend"]),
    "spend_by_supplier_country": ("Spend by supplier country", ["local_spend", "vendor_country", "supplier", "total_spend"]),
    "spend_distribution_summary": ("Spend Distribution Summary", ["business_unit", "plant_code", "plant_name", "local_spend", "supplier", "country", "total_spend"]),
    "spend_profile_monthly": ("Spend Profile - Monthly", ["business_unit", "invoice_date", "invoice_number", "plant_name", "local_spend", "supplier", "total_spend"]),
    "spend_type_analysis": ("Spend type analysis", ["contract_indicator", "invoice_po_number", "description", "po_material_number", "local_spend", "supplier", "total_spend"]),
    "supplier_rationalization": ("Supplier rationalization", ["local_spend", "supplier", "total_spend"]),
    "supplier_spend_payment_terms": ("Supplier spend distribution by payment terms", ["payment_terms", "local_spend", "supplier", "total_spend"]),
    "transaction_intensity": ("Transaction Intensity", ["contract_indicator", "invoice_po_number", "local_spend", "supplier", "total_spend"]),
    "centralized_buying": ("Centralized buying across plants/BUs", ["business_unit", "plant_code", "plant_name", "local_spend", "supplier", "total_spend"]),
    "dynamic_category_savings": ("Dynamic Category Savings", ["local_spend", "total_spend"]),
}

#: Savings levers of a category: title and the fields each needs.
LEVERS = {
    "bundling_aggregation": ("Bundling/ Aggregation of Spend", ["total_spend", "business_unit", "country", "region", "l1", "l2", "l3", "l4", "invoice_date"]),
    "bypass_intermediaries": ("By-pass Intermediaries", ["total_spend", "business_unit", "country", "po_material_description", "quantity", "l1", "l2", "l3", "l4", "uom", "supplier", "invoice_date"]),
    "complexity_reduction": ("Complexity Reduction", ["total_spend", "business_unit", "country", "po_material_description", "region", "l1", "l2", "l3", "l4", "invoice_date"]),
    "leverage_purchasing_timing": ("Leverage Appropriate Purchasing Timing", ["total_spend", "po_material_description", "quantity", "invoice_date", "l1", "l2", "l3", "l4", "uom", "supplier"]),
    "mega_supplier_strategy": ("Mega Supplier Strategy", ["total_spend", "business_unit", "country", "region", "l1", "l2", "l3", "supplier", "invoice_date"]),
    "on_time_payment": ("On-Time Payment", ["total_spend", "business_unit", "country", "invoice_po_number", "invoice_due_date", "payment_date", "l1", "l2", "l3", "l4", "vendor_country", "supplier", "invoice_date"]),
    "optimize_payment_terms": ("Optimize Payment Terms", ["total_spend", "business_unit", "country", "po_document_date", "invoice_date", "l1", "l2", "l3", "l4", "vendor_country", "supplier"]),
    "order_quantity_optimization": ("Order Quantity Optimization", ["total_spend", "business_unit", "country", "po_material_description", "invoice_po_number", "quantity", "region", "l1", "l2", "l3", "l4", "uom", "invoice_date"]),
    "penalty_avoidance": ("Penalty Avoidance", ["total_spend", "business_unit", "country", "description", "po_material_description", "l1", "l2", "l3", "l4", "invoice_date"]),
    "shift_volumes_best_price": ("Shift volumes to best price supplier", ["total_spend", "business_unit", "country", "po_material_description", "quantity", "l1", "l2", "l3", "l4", "uom", "supplier", "invoice_date"]),
    "supplier_consolidation": ("Supplier Consolidation", ["total_spend", "business_unit", "country", "region", "l1", "l2", "l3", "supplier", "invoice_date"]),
    "tail_spend_management": ("Tail Spend Management", ["total_spend", "business_unit", "country", "region", "l1", "l2", "l3", "l4", "supplier", "invoice_date"]),
    "sole_source_management": ("Sole Source Management", ["total_spend", "business_unit", "country", "l1", "l2", "l3", "l4", "supplier", "invoice_date"]),
}

#: Spend columns by shown name, and the column that holds their currency's code.
CODE_OF_SPEND = {"Total Amount paid in Local Currency": "Local Currency Code", "PO Total Amount in Local Currency": "PO Local Currency Code"}

#: Words that tell what a column's values are, in lower case.
COUNTRY_WORDS = [
    "united states", "germany", "france", "china", "india", "japan", "united kingdom", "brazil", "canada", "mexico", "australia", "italy", "spain",
    "south korea", "netherlands", "switzerland", "sweden", "belgium", "austria", "norway", "denmark", "finland", "ireland", "singapore", "taiwan",
    "thailand", "malaysia", "indonesia", "vietnam", "philippines", "poland", "czech republic", "hungary", "romania", "turkey", "south africa", "egypt",
    "nigeria", "saudi arabia", "uae", "israel", "new zealand", "argentina", "chile", "colombia", "peru", "portugal", "greece",
]
UNIT_WORDS = [
    "ea", "each", "pc", "pcs", "kg", "lb", "lbs", "ton", "mt", "l", "liter", "litre", "gal", "gallon", "m", "ft", "in", "box", "case", "pallet", "lot",
    "set", "pack", "roll", "sheet",
]
DEBIT_CREDIT_WORDS = ["h", "s", "d", "c", "debit", "credit", "dr", "cr"]
