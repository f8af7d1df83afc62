"""Keyword tables of the classifiers.  All of these are fixed values."""

from __future__ import annotations

# Content type, category, required name fragments, optional ones, value patterns.
CONTENT_SIGNATURES = (
    ("sales_transactions", "business",
     ("sale", "transaction", "order", "revenue", "amount", "total", "price", "quantity", "qty"),
     ("customer", "product", "date", "invoice", "discount", "tax", "payment", "channel"),
     (r"\$\d+", r"USD|EUR|GBP", r"credit|debit|cash")),
    ("products_catalog", "business", ("product", "sku", "item", "catalog", "upc", "ean", "asin"),
     ("name", "description", "category", "price", "cost", "brand", "weight", "dimensions"), (r"SKU-\d+", r"PROD-\d+")),
    ("services_data", "business", ("service", "hours", "rate", "billable", "consultation", "session"),
     ("client", "provider", "duration", "fee", "booking"), (r"\d+\s*hrs?", r"\d+\s*hours?", r"per\s*hour")),
    ("subscriptions", "business", ("subscription", "plan", "recurring", "mrr", "arr", "monthly", "annual", "tier"),
     ("subscriber", "start_date", "end_date", "renewal", "churn", "cancel"), (r"monthly|annual|yearly", r"basic|pro|premium|enterprise")),
    ("customers", "business", ("customer", "client", "account", "user", "member", "contact"),
     ("name", "email", "phone", "address", "segment", "tier", "ltv", "lifetime"), (r"@.*\.(com|org|net)", r"\+?\d{10,}")),
    ("events", "business", ("event", "ticket", "attendee", "registration", "venue", "conference"),
     ("date", "time", "location", "capacity", "speaker", "session"), (r"event-\d+", r"ticket-\d+")),
    ("bundles_packages", "business", ("bundle", "package", "combo", "kit", "set"), ("items", "components", "discount", "savings"),
     (r"bundle|package|combo",)),
    ("digital_assets", "business", ("download", "digital", "file", "asset", "media", "content"),
     ("format", "size", "url", "license", "version"), (r"\.(pdf|mp3|mp4|zip|exe)", r"download")),
    ("licenses", "business", ("license", "key", "activation", "seat", "entitlement"), ("expiry", "valid", "type", "edition"),
     (r"[A-Z0-9]{4}-[A-Z0-9]{4}", r"license\s*key")),
    ("memberships", "business", ("membership", "member", "club", "gym", "association"), ("tier", "benefits", "dues", "renewal"),
     (r"gold|silver|platinum|bronze",)),
    ("rentals", "business", ("rental", "lease", "rent", "tenant", "property"), ("duration", "deposit", "return", "checkout", "checkin"),
     (r"per\s*(day|week|month)", r"rental\s*period")),
    ("usage_data", "business", ("usage", "consumption", "meter", "units", "api_calls", "bandwidth"),
     ("timestamp", "user", "resource", "quota", "limit"), (r"\d+\s*(GB|MB|KB|calls|requests)",)),
    ("support_tickets", "business", ("ticket", "case", "issue", "support", "help", "incident"),
     ("status", "priority", "assigned", "resolution", "category", "sla"), (r"TICKET-\d+", r"open|closed|pending|resolved")),
    ("customer_feedback", "business", ("feedback", "review", "rating", "nps", "satisfaction", "survey"),
     ("comment", "score", "recommend", "sentiment"), (r"[1-5]\s*stars?", r"nps|csat")),
    ("marketing_data", "business", ("campaign", "marketing", "ad", "impression", "click", "conversion", "lead"),
     ("spend", "roi", "ctr", "cpc", "channel", "source"), (r"utm_", r"campaign-\d+")),
    ("financial_data", "business", ("finance", "accounting", "ledger", "debit", "credit", "balance", "expense", "income"),
     ("account", "journal", "fiscal", "budget", "variance"), (r"GL-\d+", r"acc-\d+")),
    ("operational_data", "business", ("operation", "process", "workflow", "task", "efficiency", "throughput"),
     ("cycle_time", "utilization", "capacity", "bottleneck"), (r"OPS-\d+",)),
    ("inventory", "business", ("inventory", "stock", "warehouse", "bin", "location", "quantity_on_hand"),
     ("reorder", "safety_stock", "lead_time", "supplier"), (r"WH-\d+", r"BIN-\d+")),
    ("orders", "business", ("order", "purchase", "po", "requisition"), ("status", "ship", "delivery", "tracking"), (r"ORD-\d+", r"PO-\d+")),
    ("invoices", "business", ("invoice", "bill", "statement", "due"), ("paid", "outstanding", "terms", "tax"), (r"INV-\d+", r"BILL-\d+")),
    ("employees", "business", ("employee", "staff", "worker", "hr", "personnel"), ("department", "title", "salary", "hire_date", "manager"),
     (r"EMP-\d+",)),
    ("suppliers", "business", ("supplier", "vendor", "manufacturer", "partner"), ("contact", "terms", "rating", "lead_time"),
     (r"SUP-\d+", r"VEN-\d+")),
    ("legal_cases", "legal", ("case", "verdict", "court", "plaintiff", "defendant", "litigation", "lawsuit"),
     ("judge", "attorney", "filing", "docket", "ruling", "settlement"), (r"case\s*#?\d+", r"v\.\s*", r"plaintiff|defendant")),
    ("contracts", "legal", ("contract", "agreement", "terms", "clause", "party", "signatory"),
     ("effective_date", "expiry", "renewal", "termination"), (r"contract-\d+", r"agreement")),
    ("compliance_data", "legal", ("compliance", "regulation", "audit", "violation", "policy"),
     ("risk", "control", "finding", "remediation"), (r"SOX|GDPR|HIPAA|PCI",)),
    ("training_dataset", "ml_model", ("label", "target", "class", "feature", "x_train", "y_train"), ("split", "fold", "weight", "sample"),
     (r"train|test|valid", r"feature_\d+")),
    ("embeddings", "ml_model", ("embedding", "vector", "dimension", "latent"), ("token", "word", "sentence"), (r"dim_\d+", r"vec_\d+")),
    ("metrics_kpi", "analytics", ("metric", "kpi", "measure", "indicator", "score"), ("target", "actual", "variance", "trend"),
     (r"YoY|MoM|QoQ", r"\d+%")),
    ("time_series", "analytics", ("timestamp", "datetime", "date", "time", "period"), ("value", "measure", "forecast", "actual"),
     (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}")),
    ("survey_data", "analytics", ("response", "question", "answer", "respondent", "survey"), ("scale", "choice", "open_ended"),
     (r"Q\d+", r"strongly\s*(agree|disagree)")),
)

# File name fragment and the content type it hints at.
FILENAME_HINTS = (
    ("sales", "sales_transactions"), ("transaction", "sales_transactions"), ("order", "orders"), ("customer", "customers"),
    ("product", "products_catalog"), ("service", "services_data"), ("subscription", "subscriptions"), ("ticket", "support_tickets"),
    ("support", "support_tickets"), ("feedback", "customer_feedback"), ("review", "customer_feedback"), ("inventory", "inventory"),
    ("invoice", "invoices"), ("employee", "employees"), ("hr", "employees"), ("marketing", "marketing_data"),
    ("campaign", "marketing_data"), ("finance", "financial_data"), ("legal", "legal_cases"), ("case", "legal_cases"),
    ("contract", "contracts"), ("train", "training_dataset"), ("model", "model_weights"), ("embed", "embeddings"),
)

# Role of a content type; any other is "reference".
CONTENT_ROLES = {
    "sales_transactions": "transactional", "orders": "transactional", "invoices": "transactional", "support_tickets": "interaction",
    "customer_feedback": "interaction", "customers": "master_entity", "products_catalog": "master_entity", "employees": "master_entity",
    "suppliers": "master_entity", "financial_data": "financial", "inventory": "operational", "operational_data": "operational",
    "subscriptions": "transactional", "usage_data": "transactional", "marketing_data": "analytical", "metrics_kpi": "analytical",
    "time_series": "analytical", "training_dataset": "ml_data", "embeddings": "ml_data", "legal_cases": "legal", "contracts": "legal",
}

# Wording of content types; any other is its name with "Data".
CONTENT_TEXTS = {
    "sales_transactions": "Sales/Transaction Data - Contains purchase records with revenue information",
    "products_catalog": "Product Catalog - Master list of products/items with attributes",
    "services_data": "Services Data - Service offerings with pricing and duration",
    "subscriptions": "Subscription Data - Recurring revenue and subscriber information",
    "customers": "Customer Master Data - Customer profiles and contact information",
    "support_tickets": "Support Tickets - Customer service cases and issues",
    "customer_feedback": "Customer Feedback - Reviews, ratings, and satisfaction data",
    "financial_data": "Financial Data - Accounting, ledger, or budget information",
    "inventory": "Inventory Data - Stock levels and warehouse information",
    "orders": "Order Data - Purchase orders and fulfillment records",
    "marketing_data": "Marketing Data - Campaign performance and lead information",
    "legal_cases": "Legal Case Data - Litigation, verdicts, and court records",
    "training_dataset": "ML Training Dataset - Labeled data for machine learning",
    "time_series": "Time Series Data - Sequential measurements over time",
}

# Entity and the name fragments that show it, for the content and the role classifier.
CONTENT_ENTITIES = (
    ("customer", ("customer", "client", "user", "account", "buyer")), ("product", ("product", "item", "sku", "goods")),
    ("order", ("order", "transaction", "purchase")), ("employee", ("employee", "staff", "worker")),
    ("ticket", ("ticket", "case", "issue")), ("invoice", ("invoice", "bill")),
)
ROLE_ENTITIES = (
    ("customer", ("customer", "client", "buyer", "account", "user")), ("product", ("product", "item", "sku", "goods")),
    ("service", ("service",)), ("order", ("order", "transaction", "sale", "invoice")), ("ticket", ("ticket", "case", "support")),
    ("feedback", ("feedback", "review", "rating")),
)

# Role, name patterns, keywords, characteristics looked for, number of characteristics, weight.
ROLE_SIGNALS = (
    ("transactional",
     (r"(order|transaction|invoice|sale|purchase|txn).*id", r"(order|sale|transaction|invoice).*date",
      r"(total|amount|price|revenue|sales|cost)", r"quantity|qty|units"),
     ("order", "sale", "transaction", "invoice", "purchase", "payment"), ("has_date", "has_amount"), 3, 1.0),
    ("master_entity",
     (r"(product|item|service|customer|client|user).*id", r"(name|title|description)", r"(category|type|class|status)", r"(sku|code)"),
     ("product", "item", "service", "customer", "master", "catalog"), (), 3, 0.9),
    ("interaction",
     (r"(ticket|case|support|feedback).*id", r"(customer|user|client).*id", r"(content|message|description|comment|body)",
      r"(rating|score|satisfaction)"),
     ("ticket", "support", "feedback", "complaint", "rating", "review", "case"), ("has_text_content", "has_date"), 2, 0.85),
    ("financial", (r"(cost|expense|budget|payment|invoice)", r"(debit|credit|balance)", r"(account|ledger)"),
     ("cost", "expense", "budget", "payment", "invoice", "ledger", "finance"), ("has_amount",), 2, 0.8),
    ("operational", (r"(inventory|stock|warehouse)", r"(shipment|delivery|tracking)", r"(schedule|shift|capacity)"),
     ("inventory", "stock", "shipment", "delivery", "warehouse", "schedule"), (), 1, 0.75),
    ("reference", (r"(code|id)", r"(name|label|description)"), ("category", "type", "status", "country", "region", "lookup"),
     ("small_row_count", "no_dates"), 2, 0.7),
)

# Category and keywords of the early content detector.
EARLY_CATEGORIES = (
    ("sales", ("revenue", "sales", "order", "transaction", "sku", "invoice", "amount", "profit", "margin")),
    ("products", ("product", "sku", "inventory", "stock", "unit_cost", "item", "category")),
    ("services", ("service", "subscription", "plan", "renewal", "mrr", "arr", "license")),
    ("customers", ("customer", "client", "email", "phone", "address", "segment", "crm")),
    ("marketing", ("campaign", "click", "impression", "lead", "conversion", "ad_spend", "cpc")),
    ("support", ("ticket", "issue", "priority", "resolution", "agent", "sla", "feedback")),
    ("financial", ("budget", "expense", "asset", "liability", "equity", "tax", "ledger")),
    ("legal", ("case", "docket", "plaintiff", "defendant", "court", "verdict", "judge", "statute", "litigation")),
    ("contracts", ("contract", "agreement", "clause", "effective_date", "party", "signature", "term")),
    ("model_metrics", ("accuracy", "loss", "precision", "recall", "f1", "epoch", "batch", "learning_rate")),
    ("transformer", ("attention", "head", "layer", "embedding", "token", "vocab", "mask")),
)

# Persona, domain, data category, keywords.
PERSONA_WORDS = (
    ("business", "Sales", "sales_data", ("sale", "revenue", "order", "transaction", "invoice", "deal", "booking")),
    ("business", "Customer", "customer_data", ("customer", "client", "buyer", "subscriber", "member", "user_id", "account")),
    ("business", "Product", "product_data", ("product", "item", "sku", "catalog", "inventory", "stock", "merchandise")),
    ("business", "Financial", "financial_data", ("profit", "cost", "expense", "budget", "balance", "payment", "invoice", "tax")),
    ("business", "Hr", "hr_data", ("employee", "salary", "department", "hire", "position", "payroll", "attendance")),
    ("business", "Marketing", "marketing_data", ("campaign", "lead", "conversion", "click", "impression", "ad_", "promo")),
    ("business", "Operations", "inventory_data", ("branch", "store", "warehouse", "location", "region", "territory", "supply")),
    ("analytics", "Survey", "survey_data", ("response", "survey", "rating", "score", "feedback", "opinion", "satisfaction")),
    ("analytics", "Research", "research_data", ("experiment", "control", "treatment", "sample", "observation", "study")),
    ("analytics", "Time_Series", "time_series", ("timestamp", "datetime", "date", "time", "period", "interval", "frequency")),
    ("analytics", "Geographic", "geographic_data", ("latitude", "longitude", "lat", "lng", "geo", "location", "city", "country", "state")),
    ("analytics", "Sensor", "sensor_data", ("sensor", "reading", "measurement", "temperature", "humidity", "pressure", "aqi", "pollution")),
    ("analytics", "Statistical", "statistical_data", ("mean", "median", "std", "variance", "correlation", "distribution")),
    ("ml_engineer", "Training", "training_data", ("feature", "label", "target", "train", "test", "validation", "split")),
    ("ml_engineer", "Prediction", "predictions", ("prediction", "predicted", "probability", "confidence", "score", "output")),
    ("ml_engineer", "Classification", "training_data", ("class", "category", "label", "y_true", "y_pred", "classification")),
    ("ml_engineer", "Regression", "predictions", ("actual", "predicted", "error", "residual", "mse", "rmse", "mae")),
    ("ml_engineer", "Embedding", "embeddings", ("embedding", "vector", "representation", "encoding", "latent")),
    ("ml_engineer", "Model_Meta", "feature_data", ("epoch", "loss", "accuracy", "precision", "recall", "f1", "auc")),
)

# Personas in order of precedence on ties, with dashboards and recommended analyses.
PERSONAS = ("business", "analytics", "ml_engineer", "data_scientist", "developer")
PERSONA_DASHBOARDS = {
    "business": "business_intelligence_dashboard", "analytics": "exploratory_analytics_dashboard",
    "ml_engineer": "ml_performance_dashboard", "data_scientist": "data_science_dashboard", "developer": "developer_dashboard",
}
CONTENT_DASHBOARDS = {
    "business": "power_bi_style", "analytics": "eda_analytics", "ml_engineer": "ml_metrics", "data_scientist": "data_science",
    "developer": "developer_dashboard",
}
PERSONA_ADVICE = {
    "business": ("Revenue & Profit Analysis", "Customer Segmentation", "Sales Trends & Forecasting", "Product Performance",
                 "Regional/Branch Comparison", "KPI Dashboard"),
    "analytics": ("Exploratory Data Analysis", "Statistical Summary", "Correlation Analysis", "Distribution Analysis",
                  "Outlier Detection", "Trend Analysis"),
    "ml_engineer": ("Model Performance Metrics", "Confusion Matrix", "Feature Importance", "Prediction Distribution",
                    "Error Analysis", "Model Comparison"),
    "data_scientist": ("EDA & Profiling", "Feature Engineering Ideas", "Statistical Tests", "Model Baseline", "Data Quality Report",
                       "Hypothesis Testing"),
    "developer": ("Log Analysis", "Error Rate Tracking", "Performance Metrics", "API Usage Patterns"),
}

# Content types that speak for a persona, and the weight of full confidence.
CONTENT_PERSONAS = (
    ("business", 2.5, ("sales_transactions", "products_catalog", "services_data", "subscriptions", "customers", "events",
                       "bundles_packages", "licenses", "memberships", "rentals", "invoices", "orders", "employees", "suppliers",
                       "financial_data", "inventory", "operational_data", "marketing_data", "legal_cases", "contracts")),
    ("analytics", 2.5, ("metrics_kpi", "time_series", "survey_data", "customer_feedback", "ai_analytics")),
    ("ml_engineer", 3.0, ("training_dataset", "embeddings", "model_weights", "transformer_model", "classification_model",
                          "regression_model")),
    ("business", 1.0, ("support_tickets", "usage_data")),
    ("developer", 1.0, ("support_tickets", "usage_data")),
)

# Persona of a session by the dominant content category.
SESSION_PERSONAS = {
    "business": "business_analyst", "ml_model": "ml_engineer", "analytics": "data_scientist", "legal": "legal_analyst",
    "healthcare": "operations_analyst",
}

# Canonical field, the names it goes by, and the type it should have.
CANONICAL_FIELDS = (
    ("transaction_id", ("id", "order_id", "invoice_id", "txn_id", "transaction_id", "sale_id", "record_id"), "id"),
    ("transaction_date", ("date", "order_date", "sale_date", "transaction_date", "created_at", "invoice_date", "purchase_date"), "date"),
    ("amount", ("amount", "total", "revenue", "price", "value", "sale_amount", "total_amount", "order_total", "grand_total"), "numeric"),
    ("quantity", ("quantity", "qty", "units", "count", "volume", "num_items"), "numeric"),
    ("unit_price", ("unit_price", "price", "rate", "cost_per_unit", "item_price", "selling_price"), "numeric"),
    ("customer_id", ("customer_id", "client_id", "buyer_id", "account_id", "user_id", "cust_id"), "id"),
    ("customer_name", ("customer_name", "client_name", "buyer_name", "account_name", "name", "full_name"), "text"),
    ("customer_email", ("email", "customer_email", "contact_email", "email_address"), "email"),
    ("offering_id", ("product_id", "service_id", "item_id", "sku", "offering_id", "prod_id", "item_code"), "id"),
    ("offering_name", ("product_name", "service_name", "item_name", "description", "name", "title", "product", "item"), "text"),
    ("offering_category", ("category", "type", "class", "segment", "product_category", "product_type", "group"), "text"),
    ("cost", ("cost", "cogs", "expense", "unit_cost", "cost_price", "purchase_cost", "item_cost"), "numeric"),
    ("interaction_content", ("content", "message", "body", "text", "description", "comment", "feedback", "review"), "text"),
    ("sentiment_rating", ("rating", "score", "satisfaction", "stars", "sentiment"), "numeric"),
)

# Fields a dataset role needs and fields it should have.
REQUIRED_FIELDS = {
    "transactional": ("transaction_date", "amount"), "interaction": ("interaction_content",), "financial": ("amount",),
}
RECOMMENDED_FIELDS = {
    "transactional": ("customer_id", "offering_id", "quantity", "cost"), "master_entity": ("offering_name", "offering_category"),
    "interaction": ("customer_id", "sentiment_rating"), "financial": ("transaction_date",),
}
FIELD_WARNINGS = {
    "customer_id": "Customer ID not mapped. Customer analytics will be limited.",
    "offering_id": "Product/Service ID not mapped. Offering analytics will be limited.",
    "cost": "Cost column not detected. Profit calculations will be unavailable.",
    "quantity": "Quantity not mapped. Unit economics analysis will be limited.",
    "sentiment_rating": "Sentiment/Rating not found. Satisfaction analysis will be limited.",
}
