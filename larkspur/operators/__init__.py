"""DataFrame operators over job postings, feedback and mails."""
