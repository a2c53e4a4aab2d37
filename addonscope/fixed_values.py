"""Fixed values.

Word lists, lookup tables and defaults that decide results.  They must keep
exactly these values, so they are stated as they are, in natural order.
"""

# Source encodings of the lexical masks (characters that never occur in code).
STRING_FILL = "\u0001"
COMMENT_FILL = "\u0002"
CONTINUATION = "\u0003"

# Raw field constructor (lower case) -> canonical type.
FIELD_TYPES = {
    "char": "Char",
    "text": "Text",
    "html": "Html",
    "integer": "Integer",
    "float": "Float",
    "monetary": "Monetary",
    "boolean": "Boolean",
    "date": "Date",
    "datetime": "Datetime",
    "binary": "Binary",
    "selection": "Selection",
    "reference": "Reference",
    "many2one": "Many2one",
    "one2many": "One2many",
    "many2many": "Many2many",
    "id": "Id",
    "char_utf8": "Char",
    "text_wiki": "Text",
    "float_time": "Float",
    "related": "Char",
    "function": "Char",
    "property": "Char",
}

RELATIONAL_TYPES = ["many2one", "one2many", "many2many"]

LEGACY_BASES = [
    "osv.osv",
    "osv.osv_memory",
    "osv.Model",
    "osv.TransientModel",
    "osv.AbstractModel",
    "orm.Model",
    "orm.TransientModel",
    "orm.AbstractModel",
    "orm.BaseModel",
]
MODERN_BASES = ["models.Model", "models.TransientModel", "models.AbstractModel"]

# Keyword arguments of a field that are kept.
FIELD_PARAMS = [
    "string", "required", "readonly", "compute", "inverse", "search",
    "related", "store", "comodel_name", "inverse_name", "selection",
    "default", "ondelete", "tracking", "copy", "index", "groups",
    "help", "states", "size", "digits", "translate", "domain",
    "context", "auto_join", "delegate", "track_visibility",
    "attachment", "prefetch", "company_dependent",
]

MANIFEST_FILES = ["__manifest__.py", "__openerp__.py"]
MANIFEST_STRINGS = [
    "name", "version", "summary", "description", "author", "website", "category", "license",
]
MANIFEST_LISTS = ["depends", "data", "demo", "images", "css", "qweb"]
MANIFEST_FLAGS = {"installable": True, "application": False, "auto_install": False}
MANIFEST_MAPS = ["external_dependencies", "assets"]

ACCEPTED_EXTENSIONS = ["py", "xml", "csv", "txt", "po"]
ARCHIVE_EXTENSION = "zip"

ACTION_MODELS = [
    "ir.actions.act_window",
    "ir.actions.act_window.view",
    "ir.actions.server",
    "ir.actions.client",
    "ir.actions.report.xml",
    "ir.actions.act_url",
]
VIEW_MODEL = "ir.ui.view"
MENU_MODEL = "ir.ui.menu"
RULE_MODEL = "ir.rule"
VIEW_TYPES = [
    "form", "tree", "list", "kanban", "search", "graph", "pivot",
    "calendar", "gantt", "diagram", "qweb", "activity", "cohort", "map",
]
# (substring of the view name, type), first match wins.
VIEW_TYPE_BY_NAME = [
    ("form", "form"),
    ("tree", "tree"),
    ("list", "tree"),
    ("kanban", "kanban"),
    ("search", "search"),
    ("graph", "graph"),
    ("pivot", "pivot"),
    ("calendar", "calendar"),
]
DEFAULT_VIEW_MODE = "tree,form"
DEFAULT_REPORT_TYPE = "qweb-pdf"
DEFAULT_PRIORITY = 16
DEFAULT_SEQUENCE = 10

SEVERITIES = ["critical", "warning", "info"]
SEVERITY_WEIGHT = {"critical": 10, "warning": 3, "info": 1}
CATEGORIES = [
    "deprecated", "security", "performance", "bad_practice", "missing", "inheritance",
    "data_integrity",
]
ROLES = ["Admin", "Reviewer", "Developer", "Viewer"]

# Diagram field type of a canonical type (lower case); anything else is "string".
DIAGRAM_TYPES = {
    "char": "string",
    "text": "string",
    "html": "string",
    "selection": "string",
    "integer": "int",
    "float": "float",
    "monetary": "float",
    "boolean": "bool",
    "date": "date",
    "datetime": "datetime",
    "binary": "binary",
    "many2one": "fk",
    "one2many": "list",
    "many2many": "list",
    "reference": "ref",
}
CARDINALITY = {"many2one": "}o--||", "one2many": "||--o{", "many2many": "}o--o{"}
DEFAULT_CARDINALITY = "||--||"
DIAGRAM_FIELD_CAP = 8
REPORT_RELATION_CAP = 30
AUDIT_PAGE = 200

STATE_CATEGORIES = {
    "draft": ["draft", "new"],
    "active": ["active", "confirmed", "open", "sent", "progress", "in_progress", "sale"],
    "done": ["done", "paid", "posted", "completed"],
    "cancel": ["cancel", "cancelled", "refused", "rejected"],
}

# Source state that a part of a method's name suggests, first match wins; SECOND_STATE stands for the
# second state of the model.
SECOND_STATE = "second"
SOURCE_BY_METHOD = [
    ("approve", "draft"),
    ("confirm", "draft"),
    ("done", SECOND_STATE),
    ("complete", SECOND_STATE),
    ("cancel", "checking"),
    ("reset", "cancelled"),
    ("draft", "cancelled"),
]

DEFAULT_VERSION = "Odoo 14.0"
LEGACY_VERSION = "Odoo 8.0 atau lebih rendah"
VERSION_PREFIX = "Odoo "

WEBHOOK_DEFAULTS = {"repo": "Unknown repo", "branch": "main", "message": "No message"}
