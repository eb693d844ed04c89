"""Fixed values of the organizer: words in names and texts, vendors, and where kinds of files belong."""

from __future__ import annotations

FILENAME_KEYWORDS = (
    "payslip", "salary", "paystub", "invoice", "bill", "receipt", "statement", "tax", "w2", "w-2", "1099", "form16", "form-16", "itr", "1040",
    "offer", "insurance", "policy", "passport", "license", "aadhaar", "pan", "contract", "agreement", "resume", "cv",
)
VENDORS = ("Amazon", "Uber", "DoorDash", "Whole Foods", "Home Depot", "Costco", "Target", "Walmart", "Apple", "Best Buy")
INSTITUTIONS = ("Chase", "Wells Fargo", "Bank of America", "Citi", "Discover", "HDFC", "ICICI", "SBI", "Amex", "Capital One")
BROKERAGES = ("Vanguard", "Fidelity", "Charles Schwab", "Robinhood", "E*TRADE", "Merrill", "TD Ameritrade")
#: Classes of texts with their phrases and weights; the order decides ties.
TEXT_CLASSES = {
    "payslip": {"Gross Pay": 3, "Net Pay": 3, "Employee ID": 2, "YTD": 1, "Basic": 1, "HRA": 1, "Deductions": 2, "Pay Period": 2},
    "receipt": {"Receipt": 2, "Order #": 2, "Order Number": 2, "Subtotal": 1, "Tax": 1, "Total": 1, "Payment Method": 2, "Thank you": 1},
    "bank_statement": {"Statement Period": 3, "Opening Balance": 3, "Closing Balance": 3, "Account Number": 2, "IFSC": 1, "Routing": 1},
    "tax_form": {"W-2": 4, "1099": 4, "Form 16": 4, "ITR": 3, "Assessment Year": 2, "Total Tax": 2, "Employer Identification": 2, "1040": 4},
    "invoice": {"Invoice #": 3, "Invoice Number": 3, "Bill To": 2, "Ship To": 1, "Due Date": 2, "Terms": 1, "PO Number": 1},
    "offer_letter": {"Offer": 2, "Position": 2, "Salary": 2, "Start Date": 2, "pleased to offer": 3, "terms of employment": 3, "CTC": 2},
    "insurance": {"Policy Number": 3, "Premium": 2, "Coverage": 2, "Beneficiary": 2, "Insured": 1, "Deductible": 1},
    "investment": {"Portfolio": 2, "Holdings": 2, "Dividend": 2, "NAV": 2, "Cost Basis": 2, "Unrealized": 1, "Broker": 1},
    "id_document": {"Passport": 4, "Driving License": 3, "PAN": 3, "Aadhaar": 3, "Social Security": 3, "Date of Birth": 1, "Nationality": 2},
    "legal": {"WHEREAS": 3, "hereby agree": 2, "NOTARY": 2, "party of the first part": 3, "in witness whereof": 2},
}
#: Rules: id, domain, folder template, precedence, and tests as (kind, argument, weight); a rule's score is its best test's.
RULES = (
    ("hr.payslip", "HR", "Payslips/{year}", 90, (("text", "payslip", 0.9), ("word", ("payslip", "salary", "paystub"), 0.5))),
    ("hr.offer", "HR", "OfferLetters/{year}", 85, (("text", "offer_letter", 0.9), ("word", ("offer",), 0.4))),
    ("hr.tax", "HR", "Tax/{year}", 88, (("text", "tax_form", 0.9), ("word", ("w2", "w-2", "1099", "form16", "form-16", "itr", "1040", "tax"), 0.7))),
    ("personal.ids", "Personal", "IDs", 85, (("text", "id_document", 0.9), ("word", ("passport", "license", "aadhaar", "pan"), 0.7))),
    ("personal.insurance", "Personal", "Insurance/{year}", 80, (("text", "insurance", 0.85), ("word", ("insurance", "policy"), 0.5))),
    ("fin.receipt", "Finances", "Receipts/{year}/{vendor}", 82, (("text", "receipt", 0.9), ("word", ("receipt",), 0.6), ("issuer", "vendor", 0.55))),
    ("fin.statement", "Finances", "Statements/{year}/{institution}", 82, (("text", "bank_statement", 0.9), ("word", ("statement",), 0.5), ("issuer", "institution", 0.6))),
    ("fin.invoice", "Finances", "Invoices/{year}", 78, (("text", "invoice", 0.85), ("word", ("invoice", "bill"), 0.6))),
    ("fin.investment", "Finances", "Investments/{year}", 78, (("text", "investment", 0.85), ("issuer", "brokerage", 0.65))),
    ("photo.event", "Photos", "{year}/{yyyy_mm}", 60, (("mime", "image", 0.7),)),
    ("video.event", "Videos", "{year}/{yyyy_mm}", 60, (("mime", "video", 0.7),)),
    ("media.music", "Media", "Music/{artist}/{album}", 95, (("tags", "", 0.9),)),
    ("media.books", "Media", "Books", 55, (("word", ("book", "ebook", "epub"), 0.4),)),
    ("work.docs", "Work", "{year}", 50, (("word", ("resume", "cv", "proposal", "deck"), 0.4),)),
)
