"""Schemas of the nested records, as Spark DDL."""

JOB = """id string, company string,
 basic_info struct<title:string, department:string, location:string, job_type:string, salary_negotiable:boolean, salary_min:int, salary_max:int, salary_months_min:int, salary_months_max:int, intern_salary_amount:int, intern_salary_unit:string, currency:string, summary:string, responsibilities:array<string>, highlights:array<string>>,
 skill_requirements struct<required:array<struct<name:string, level:string, min_years:double, description:string>>, optional_groups:array<struct<group_name:string, description:string, min_required:int, skills:array<struct<name:string, level:string, description:string>>>>, bonus:array<struct<name:string, weight:int, description:string>>>,
 experience_requirements struct<core:array<struct<type:string, name:string, min_years:double, description:string, keywords:array<string>>>, bonus:array<struct<type:string, name:string, weight:int, description:string, keywords:array<string>>>, min_total_years:double, max_total_years:double>,
 education_constraints struct<min_degree:string, prefer_degrees:array<string>, required_majors:array<string>, preferred_majors:array<string>, languages:array<struct<language:string, level:string, required:boolean>>, certifications:array<string>, age_range:string, other:array<string>>,
 tags array<struct<name:string, category:string, weight:int, slug:string, filterable:boolean, facet_key:string, facet_value:string>>,
 filter_facets struct<role_categories:array<string>, work_modes:array<string>, city_tokens:array<string>, ai_capabilities:array<string>, is_internship:boolean, seniority_level:string, salary_band:string, posted_at:timestamp, posted_days_ago:int, min_experience_years:double, max_experience_years:double>"""

RESUME = """id string,
 basic_info struct<name:string, work_years:int, current_city:string, current_title:string, current_company:string, summary:string, self_evaluation:string, first_degree:string>,
 educations array<struct<school:string, degree:string, major:string, start_year:string, end_year:string>>,
 work_experiences array<struct<company_name:string, industry:string, title:string, level:string, location:string, start_date:string, end_date:string, responsibilities:array<string>, achievements:array<string>, tech_stack:array<string>>>,
 projects array<struct<name:string, role:string, domain:string, description:string, responsibilities:array<string>, achievements:array<string>, tech_stack:array<string>>>,
 skills array<struct<name:string, level:string, years:int, last_used_year:int>>,
 tags array<struct<name:string, category:string, weight:int, slug:string, filterable:boolean, facet_key:string, facet_value:string>>,
 expected_salary struct<min:int, max:int, currency:string>,
 filter_facets struct<role_categories:array<string>, target_cities:array<string>, preferred_work_modes:array<string>, ai_capabilities:array<string>, seniority_level:string, inferred_salary_min:int, inferred_salary_max:int>,
 raw_text string"""

FILTERS = "resume_id string, role_categories array<string>, work_modes array<string>, internship_preference string, posted_within_days int, min_experience_years double, max_experience_years double"
VECTORS = "namespace string, item_id string, payload_hash string, vector array<float>, updated_at timestamp"
