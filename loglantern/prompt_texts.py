"""The texts of prompts and of the answers given without a model.

``{name}`` marks a place to fill.
"""

SUMMARY_PROMPT = """Analyze this {platform} build log and provide a structured summary.

Build Information:
- Platform: {platform}
- Job Name: {job_name}
- Build Status: {status}
- Error Count: {error_count}
- Warning Count: {warning_count}
- Duration: {duration}

Log Content (first {log_size} characters):
{log_content}

Provide a summary in this exact format:

**STATUS**: [Success/Failed/Timeout/Unstable]

**MAIN ISSUE**: [One sentence describing the primary problem, or "Build completed successfully" if no issues]

**KEY POINTS**:
- [Point 1: Most critical finding]
- [Point 2: Secondary finding]
- [Point 3: Additional detail]
- [Additional points if needed, max 5 total]

**IMPACT**: [Low/Medium/High/Critical] - [Brief reason]

**CONFIDENCE**: [0-100]%

Keep it concise. Focus on actionable information.
"""

EXPLAIN_PROMPT = """Analyze this CI/CD build error and provide a detailed explanation.

Error Information:
- Platform: {platform}
- Error Type: {error_type}
- Line Number: {line_number}
- Error Message:
{error_message}

Build Context:
- Job: {job_name}
- Stage: {stage_name}
- Previous Stages: {previous_stages}

Additional Context:
{additional_context}

Provide explanation in this format:

**ROOT CAUSE**:
[Clear explanation of why this error occurred]

**COMMON SCENARIOS**:
[List 2-3 common situations that lead to this error]
- Scenario 1: ...
- Scenario 2: ...
- Scenario 3: ...

**TECHNICAL DETAILS**:
[What's happening under the hood - be specific and technical]

**RELATED ERRORS**:
[If this error typically comes with other issues, mention them]

Be specific to the {platform} platform and the error context provided.
"""

FIX_PROMPT = """You are a DevOps engineer. Provide concrete fix steps for this CI/CD build error.

Error Summary:
{error_summary}

Build Context:
- Platform: {platform}
- Job Name: {job_name}
- Build Environment: {environment}
- Stage Failed: {failed_stage}

Error Details:
{error_details}

Stack Trace (if available):
{stack_trace}

Provide fix suggestions in this format:

**QUICK FIX** (if available):
```bash
# Immediate command(s) that might fix the issue
[command]
```

**DETAILED STEPS**:
1. [First step - most important]
   ```bash
   # Command if needed
   ```
   
2. [Second step]
   ```bash
   # Command if needed
   ```

3. [Continue with 3-5 numbered steps total]

**CODE CHANGES** (if needed):
File: `path/to/file`
```language
[Show exact code change needed]
```

**PREVENTION TIPS**:
- [How to prevent this error in the future]
- [Best practice to follow]
- [Tool or check to add to CI]

**VERIFICATION**:
[How to verify the fix worked]

**CONFIDENCE**: [0-100]% - [Brief reason for confidence level]

Provide platform-specific, actionable steps. Include exact commands and code when possible.
"""

RANKING_PROMPT = """Analyze multiple errors from a CI/CD build and prioritize them.

Build Information:
- Platform: {platform}
- Job: {job_name}
- Total Errors: {error_count}

Errors:
{errors_list}

Provide analysis in this format:

**PRIORITY RANKING**:
1. [Error name] - [Why this is most critical]
2. [Error name] - [Why this is second priority]
3. [Continue...]

**ROOT CAUSE ANALYSIS**:
[Are these errors related? Is there a common root cause?]

**FIX ORDER**:
[Which errors should be fixed first and why? Will fixing one resolve others?]

**RECOMMENDED ACTION**:
[Single most important action to take right now]

Focus on dependencies between errors and optimal fix order.
"""

COMPARISON_PROMPT = """Compare a failed build with a successful build to identify what changed.

Failed Build:
- Build #: {failed_build_number}
- Status: {failed_status}
- Key Errors:
{failed_errors}

Successful Build (previous):
- Build #: {success_build_number}
- Status: Success
- Summary:
{success_summary}

Changes Between Builds:
{git_changes}

Provide analysis:

**WHAT CHANGED**:
[List the key differences between builds]

**LIKELY CAUSE**:
[Based on changes, what most likely caused the failure]

**ROLLBACK OPTION**:
[Can this be rolled back? How?]

**FIX APPROACH**:
[Best approach to fix based on the changes]
"""

# --- fixed values: answers given without a model ---------------------------------
FALLBACK_KEY_POINT = "See full log for details"
FALLBACK_SUMMARY_CONFIDENCE = 50
FALLBACK_EXPLANATION_CONFIDENCE = 40
FALLBACK_FIX_CONFIDENCE = 40
FALLBACK_SCENARIOS = (
    "Check recent code/config changes",
    "Verify environment setup",
    "Review build logs for context",
)
FALLBACK_DETAILS = "LLM explanation unavailable. Check error message and context."
FALLBACK_STEPS = (
    "Review the error message carefully",
    "Check recent code or configuration changes",
    "Verify environment setup and dependencies",
    "Consult relevant documentation",
    "Search for similar errors online",
)
FALLBACK_TIPS = ("Add validation checks", "Improve error handling", "Add relevant tests")
FALLBACK_VERIFICATION = "Re-run the build after applying fixes"

# --- fixed values: defaults for sections missing from a stored answer -------------
DEFAULT_KEY_POINTS = ("No key points extracted",)
DEFAULT_SUMMARY_CONFIDENCE = 75
DEFAULT_ROOT_CAUSE = "Unable to determine root cause from log context."
DEFAULT_DETAILS = "See error message for details."
DEFAULT_SCENARIOS = ("Check error message", "Review recent code changes")
DEFAULT_EXPLANATION_CONFIDENCE = 80
DEFAULT_DIAGNOSIS = "Unable to diagnose the issue from available information."
DEFAULT_STEPS = ("Review the error message", "Check recent changes", "Consult documentation")
DEFAULT_VERIFICATION = "Re-run the build to verify the fix."
DEFAULT_FIX_CONFIDENCE = 75
