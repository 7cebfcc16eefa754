"""Reference prices and lot assumptions."""

# Fixed values: (id, model, provider, USD per million input tokens).
PRICES = (
    ("deepseek-v3", "DeepSeek V3", "DeepSeek", 0.27),
    ("gemini-2-flash", "Gemini 2.0 Flash", "Google", 0.10),
    ("gpt-4o-mini", "GPT-4o Mini", "OpenAI", 0.15),
    ("gpt-4o", "GPT-4o", "OpenAI", 2.50),
    ("claude-35-sonnet", "Claude 3.5 Sonnet", "Anthropic", 3.00),
    ("grok-2", "Grok 2", "xAI", 2.00),
)

# Defaults of a lot analysis.
PRICE_PER_MILLION = 2.50
DAILY_VOLUME = 10_000
MONTH_DAYS = 30
PREVIEW_ROWS = 50
PREVIEW_CHARS = 300
